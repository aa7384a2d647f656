"""Operator 2: URL filters by a path-template tree, in DataFrame operations alone.

Rules label the urls that they fit.  For all others the tree of their host judges:

1. A path's variable segments become wildcards: numbers, hexadecimal and mixed identifiers by their form, and
   the children of a node with many children that are hardly ever seen twice.
2. Branches of a host that differ in one level alone are merged if their labels agree statistically: each one's
   share of blocked urls lies within two standard errors of the merged share.  A branch without labels joins two
   or more such branches if its subtree has their shape: the template's share of the branch's urls is theirs, within
   two standard errors.
3. A template's purity is its share of blocked urls among labelled ones, smoothed towards its host's share, that towards the
   share of the domain (the last two parts of the host), and that towards the share of all urls.
   A template without labels that joins no others has the counts of the nearest node above it that has labels.  Templates
   with enough labelled urls and a high purity are rejected; where all labels are inherited, they must be of two
   branches at least.  Hosts without any labelled url reject nothing.

Cases: null urls and urls without ``://`` have empty host and path, fit no rule and are allowed, unless other urls of empty
hosts are labelled.  Of rules that fit, the longest decides, and of equally long ones the last.  Of merged branches
with equally many labels the last mask in order decides.  Urls of any length are read whole: levels from ``DEPTH`` on are
one segment of the tree, so that urls which differ there stay apart.  Repeated rows are judged alike; an empty table gives
an empty result.  Columns of the input named as those of the result may be asked for only under other names.
Work on paths runs once per host and form of path, not per url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import cut, table

#: Fixed values of the task: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Levels of a tree; what follows is one segment of the last.
DEPTH = 8
#: A node's children are a wildcard if there are so many and each is seen less often than REPEATS on average.
CHILDREN, REPEATS = 20, 2.0
#: Weight of the overall share in a purity; labelled urls and purity that a rejection needs.
SMOOTHING, SUPPORT, PURITY = 5.0, 5, 0.8
#: Rows (about 300 bytes each) up to which judged templates are broadcast; a larger table is joined by shuffle.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    none = lambda c: F.coalesce(c, F.lit(""))
    return none(F.translate(host, _UPPER, _LOWER)), none(F.regexp_extract(tail, r"^[^?#]*", 0))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null where none fits.  For some hundred rules at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def form(segment: Column) -> Column:
    """A segment, or the wildcard of its form."""
    end = F.regexp_extract(segment, r"(\.[a-z]{1,5})?$", 0)
    stem = F.regexp_replace(segment, r"(\.[a-z]{1,5})?$", "")
    wild = F.when(stem.rlike(r"^\d+$"), "{n}").when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "{hex}").when(stem.rlike(r"^(?=.*\d.*\d.*\d)[\w-]{12,}$"), "{id}")
    return F.coalesce(F.concat(wild, end), segment)


def path_form(path: Column) -> Column:
    """A path's segments with wildcards for those of a variable form, as an array."""
    forms = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), form)
    rest = F.array_join(F.slice(forms, DEPTH, F.greatest(F.size(forms), F.lit(1))), "/")
    return F.when(F.size(forms) > DEPTH, F.concat(F.slice(forms, 1, DEPTH - 1), F.array(rest))).otherwise(forms)


def domain(host: Column) -> Column:
    """The last two parts of a host."""
    return F.substring_index(host, ".", -2)


def smoothed(bad: Column | str, labelled: Column | str, towards: Column) -> Column:
    """A share of blocked urls, drawn towards another where labels are few."""
    count = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
    return (count(bad) + SMOOTHING * towards) / (count(labelled) + SMOOTHING)


def host_purity(forms: DataFrame, prior: float) -> DataFrame:
    """(host, above): the share of each host, smoothed towards its domain's and that towards all urls'."""
    hosts = forms.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).withColumn("domain", domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.sum("l").alias("dl"), F.sum("b").alias("db"))
    return hosts.join(domains, "domain").select("host", smoothed("b", "l", smoothed("db", "dl", F.lit(prior))).alias("above"))


def templates(forms: DataFrame) -> DataFrame:
    """(host, form, n, labelled, blocked), form an array, to host, form, template, support, bad, enough.

    Support and bad count the labelled and the blocked urls of the merged template, or of the node above that an
    unlabelled one inherits from; enough is false if they are inherited from a single branch.
    """
    nodes = forms.select("host", "form", "n", F.posexplode("form").alias("level", "segment"))
    nodes = nodes.withColumn("parent", F.expr("slice(form, 1, level)"))
    wide = nodes.groupBy("host", "parent", "segment").agg(F.sum("n").alias("n")).groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("urls"))
    wide = wide.where((F.col("children") >= CHILDREN) & (F.col("urls") < REPEATS * F.col("children"))).select("host", "parent", F.lit(True).alias("wide"))
    named = nodes.join(wide, ["host", "parent"], "left").withColumn("segment", F.when(F.col("wide"), "{*}").otherwise(F.col("segment")))
    named = named.groupBy("host", "form").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "segment"))), lambda s: s["segment"]).alias("template"))
    full = forms.join(named, ["host", "form"], "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    alone = full.groupBy("host", "template").agg(*sums)
    # every level of a template: the branch that it is in there, and what share of the branch's urls it has
    levels = alone.where("size(template) > 0").select("*", F.explode(F.sequence(F.lit(0), F.size("template") - 1)).alias("level"))
    levels = levels.withColumn("branch", F.expr("slice(template, 1, level + 1)"))
    branches = levels.groupBy("host", "branch").agg(F.sum("n").alias("branch_n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # branches that differ in one level
    masks = levels.withColumn("mask", F.expr("transform(template, (s, i) -> if(i = level, '{|}', s))"))
    masks = masks.join(branches.select("host", "branch", "branch_n"), ["host", "branch"])
    known = F.col("labelled") > 0
    pools = [F.count_if(known).alias("sources"), F.sum("labelled").alias("pool_labelled"), F.sum("blocked").alias("pool_blocked")]
    shape = [F.sum(F.when(known, F.col(c))).alias(f"pool_{c}") for c in ("n", "branch_n")]
    pooled = masks.groupBy("host", "mask").agg(*pools, *shape).where("sources > 1")
    share, part = F.col("pool_blocked") / F.col("pool_labelled"), (F.col("pool_n") + 1) / (F.col("pool_branch_n") + 2)
    near = F.abs(F.col("blocked") / F.col("labelled") - share) <= 2 * F.sqrt(share * (1 - share) / F.col("labelled")) + 0.02
    shaped = F.abs(F.col("n") / F.col("branch_n") - part) <= 2 * F.sqrt(part * (1 - part) / F.col("branch_n")) + 0.02
    alike = masks.join(pooled, ["host", "mask"]).where(F.when(known, near).otherwise(shaped)).select(*masks.columns)
    merged = alike.groupBy("host", "mask").agg(*pools).where("sources > 1")
    best = alike.select("host", "template", "mask").join(merged, ["host", "mask"]).groupBy("host", "template").agg(F.max(F.struct("pool_labelled", "mask", "pool_blocked", "sources")).alias("best"))
    judged = alone.join(best, ["host", "template"], "left").select(
        "host", "template", F.coalesce("best.mask", "template").alias("merged"), F.coalesce("best.pool_labelled", "labelled").alias("support"), F.coalesce("best.pool_blocked", "blocked").alias("bad"),
        F.coalesce("best.sources", known.cast("bigint")).alias("sources"),
    )
    # what is left without labels inherits from the nearest node above
    nodes = branches.where(known).groupBy("host", F.expr("slice(branch, 1, size(branch) - 1)").alias("node")).agg(*pools)
    bare = judged.where("support = 0 AND size(template) > 0").select("host", "template", F.explode(F.sequence(F.lit(0), F.size("template") - 1)).alias("depth"))
    above = bare.withColumn("node", F.expr("slice(template, 1, depth)")).join(nodes, ["host", "node"])
    above = above.groupBy("host", "template").agg(F.max(F.struct("depth", "pool_labelled", "pool_blocked", "sources")).alias("above"))
    judged = judged.join(above, ["host", "template"], "left").select(
        "host", "template", "merged", F.coalesce("above.pool_labelled", "support").alias("support"), F.coalesce("above.pool_blocked", "bad").alias("bad"),
        F.when(F.col("above").isNotNull(), F.col("above.sources")).otherwise(F.col("sources")).alias("sources"), (F.col("support") > 0).alias("own"),
    )
    template = F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template")
    enough = (F.col("own") | (F.col("sources") > 1)).alias("enough")
    return full.select("host", "form", "template").join(judged, ["host", "template"]).select("host", "form", template, "support", "bad", enough)


def filter_urls(pages: DataFrame, url: str = "url", columns: tuple[str, ...] = ("page_id",), rules=RULES) -> DataFrame:
    """``columns`` of each row, host, path, rule, verdict, template and purity."""
    if clash := {"host", "path", "rule", "verdict", "template", "purity"} & set(columns):
        raise ValueError(f"columns of the result too: {sorted(clash)}")
    host, path = host_and_path(F.col(url))
    base = pages.select(*columns, host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), says.alias("says"), path_form(F.col("path")).alias("form"))
    forms = cut(base.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("says").alias("labelled"), F.count_if(F.col("says") == "block").alias("blocked")))
    prior = forms.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("p")).first()["p"]
    prior = 0.5 if prior is None else float(prior)
    purity = smoothed("bad", "support", F.col("above"))
    judged = cut(templates(forms).join(host_purity(forms, prior), "host").select("host", "form", "template", purity.alias("purity"), (F.col("enough") & (F.col("support") >= SUPPORT) & (purity >= PURITY)).alias("reject")))
    side = F.broadcast(judged) if judged.count() <= BROADCAST_ROWS else judged
    own = F.coalesce("says", F.when(F.col("reject"), "block").otherwise("allow"))
    return base.join(side, ["host", "form"], "left").select(*columns, "host", "path", "rule", own.alias("verdict"), "template", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))
