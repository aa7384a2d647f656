"""Selection policies, their capture in closed form and by keyed-hash simulation, and deterrence.

Replicates are rows: each store is exploded over the simulations' numbers, and all draws are hashes of
(simulation, store), so results don't depend on partitioning and SQL can restate them.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions.rng import beta_draw_sql, uniform, uniform_digits, uniform_sql, with_beta_draw
from sparkwarden.functions.stats import lowest_within, place_within
from sparkwarden.plans.registry import query
from sparkwarden.sources.shared import settled
from sparkwarden.sources.tables import LAMBDA, STORES, stores, table

KAPPA = 5.0


def replicates(df: DataFrame, n: int, name: str = "sim", deal: bool = True) -> DataFrame:
    """Each row n times, numbered; rows are dealt over all cores first, as a small table may lie in one partition."""
    if deal:
        df = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def beta_prior(p: Column) -> tuple[Column, Column]:
    """Beta parameters with mean p and strength KAPPA."""
    inside = F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))
    return KAPPA * inside, KAPPA * (1 - inside)


@query(
    "by2_posterior_update",
    f"WITH {STORES}, k AS (SELECT o_custkey AS store, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS v FROM orders GROUP BY 1), a AS (SELECT store, 5.0::DOUBLE * greatest(least(p, 1 - 1e-4), 1e-4) + coalesce(v, 0) AS alpha, 5.0::DOUBLE * (1 - greatest(least(p, 1 - 1e-4), 1e-4)) + coalesce(n - v, 0) AS beta FROM stores LEFT JOIN k USING (store)) SELECT store, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS mean FROM a",
)
def posterior_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta prior around the predicted risk, updated by checks (BY1, BY2)."""
    k = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("store")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("v"))
    a, b = beta_prior(F.col("p"))
    rows = stores(spark, sf_dir).join(k, "store", "left").select("store", (a + F.coalesce("v", F.lit(0))).alias("a"), (b + F.coalesce(F.col("n") - F.col("v"), F.lit(0))).alias("b"))
    return rows.select("store", F.round("a", 6).alias("alpha"), F.round("b", 6).alias("beta"), F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("mean"))


@query("by3_thompson_draws", f"WITH {STORES}, g AS (SELECT store, h, det, {beta_draw_sql(f'{KAPPA}::DOUBLE * greatest(least(p, 1 - 1e-4), 1e-4)', f'{KAPPA}::DOUBLE * (1 - greatest(least(p, 1 - 1e-4), 1e-4))', 'thompson', 'store')} AS draw FROM stores) SELECT store, round(draw, 6) AS draw, round(h * draw + 0.25 * det, 6) AS prize FROM g")
def thompson_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posterior draw per store, and the prize that it gives (BY3)."""
    a, b = beta_prior(F.col("p"))
    rows = with_beta_draw(stores(spark, sf_dir), a, b, "thompson", "store")
    return rows.select("store", F.round("draw", 6).alias("draw"), F.round(F.col("h") * F.col("draw") + LAMBDA * F.col("det"), 6).alias("prize"))


@query(
    "by4_random_quota",
    f"WITH {STORES}, r AS (SELECT store, tract, row_number() OVER (PARTITION BY tract ORDER BY {uniform_sql('quota', 'store')}, store) AS rn, count(*) OVER (PARTITION BY tract) AS n FROM stores) SELECT store, tract FROM r WHERE rn <= greatest(1, round_even(0.2 * least(n, 20), 0))",
)
def random_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each tract's budget of 20, one at least, drawn without replacement."""
    s = stores(spark, sf_dir).select("store", "tract", uniform("quota", "store").alias("u"))
    n = s.groupBy("tract").agg(F.count("*").alias("n")).select(F.col("tract").alias("t"), F.greatest(F.lit(1.0), F.bround(0.2 * F.least("n", F.lit(20)), 0)).alias("quota"))
    # a fixed limit, so that each task keeps four rows of a tract before the shuffle
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("tract").orderBy("u", "store"))).where("rn <= 4")
    return r.join(n, F.col("tract").eqNullSafe(F.col("t"))).where("rn <= quota").select("store", "tract")


_SCORES = f"sc AS (SELECT store, tract, p, {uniform_sql('noise', 'store')} AS u, {uniform_sql('noise', 'store')} AS random_score, 1000 * least(v36, 3) + 10 * v36 - days_since / 1000.0::DOUBLE AS violators_score, CASE WHEN v36 >= 1 AND days_since >= 180 THEN 1000 + days_since / 10.0::DOUBLE ELSE 0 END AS followup_score, p AS risk_score, prize AS prize_score FROM stores)"


@query(
    "pl1_policies",
    f"WITH {STORES}, {_SCORES}, l AS (UNPIVOT sc ON random_score, violators_score, followup_score, risk_score, prize_score INTO NAME policy VALUE score), r AS (SELECT *, row_number() OVER (PARTITION BY tract, policy ORDER BY score DESC, u, store) AS rn FROM l) SELECT replace(policy, '_score', '') AS policy, tract, count(*) AS checks, round(sum(p), 5) AS expected, min(store) AS first_store FROM r WHERE rn <= 8 GROUP BY ALL",
)
def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scoring policies, the best eight stores of each tract (PL1 to PL4, ML9)."""
    u = uniform("noise", "store")
    due = (F.col("v36") >= 1) & (F.col("days_since") >= 180)
    scored = stores(spark, sf_dir).select(
        "store", "tract", "p", u.alias("u"), u.alias("random"),
        (1000 * F.least("v36", F.lit(3)) + 10 * F.col("v36") - F.col("days_since") / 1000.0).alias("violators"),
        F.when(due, 1000 + F.col("days_since") / 10.0).otherwise(0.0).alias("followup"), F.col("p").alias("risk"), F.col("prize"),
    )
    long = scored.unpivot(["store", "tract", "p", "u"], ["random", "violators", "followup", "risk", "prize"], "policy", "score")
    w = Window.partitionBy("tract", "policy").orderBy(F.desc("score"), "u", "store")
    return long.withColumn("rn", F.row_number().over(w)).where("rn <= 8").groupBy("policy", "tract").agg(F.count("*").alias("checks"), F.round(F.sum("p"), 5).alias("expected"), F.min("store").alias("first_store"))


@query(
    "cp1_capture_table",
    f"WITH {STORES}, r AS (SELECT tract, p, row_number() OVER (PARTITION BY tract ORDER BY p DESC, store) AS rn, count(*) OVER (PARTITION BY tract) AS n_all FROM stores), g AS (SELECT r.*, least(b.n, n_all) AS n, b.n AS budget FROM r, (VALUES (4), (11), (44)) b(n)) SELECT tract, budget, round(min(n) * avg(p), 5) AS expected, round(sum(p), 5) AS census, round(min(n) / CAST(count(*) AS DOUBLE) * sum(p), 5) AS srs, round(sum(1 - pow(1 - p / n_all, n)), 5) AS iid, round(1 - pow(1 - 1 / CAST(count(*) AS DOUBLE), min(n)), 6) AS coverage_iid, round(sum(CASE WHEN rn <= n THEN p ELSE 0 END), 5) AS targeted, round(sum(1 - pow(1 - p, 2)), 5) AS two_pass, round(0.73 * sum(p), 5) AS repeats, round(0.73 * sum(p * p), 5) AS repeat_hits, round(sqrt(sum(p * (1 - p))) / count(*), 6) AS se_census, round(sqrt(avg(p) * (1 - avg(p)) / min(n)), 6) AS se_sample, round(least(sum(CASE WHEN rn <= n THEN p ELSE 0 END), 1.5 * min(n) * avg(p)), 5) AS discounted, round(count(*) * ln(1 / (1 - 0.95::DOUBLE)), 4) AS iid_budget_95 FROM g GROUP BY tract, budget",
)
def capture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and distinct violators by policy and budget, exactly (CP1 to CP5, CP7, NB11, NB12)."""
    s = stores(spark, sf_dir).select("store", "tract", "p")
    budgets = F.array(F.lit(4), F.lit(11), F.lit(44))
    # only the best 44 of a tract are ranked; a fixed limit lets each task drop the others before the shuffle
    best = s.withColumn("rn", F.row_number().over(Window.partitionBy("tract").orderBy(F.desc("p"), "store"))).where("rn <= 44").withColumn("budget", F.explode(budgets))
    best = best.where("rn <= budget").groupBy("tract", "budget").agg(F.sum("p").alias("top")).select(F.col("tract").alias("t"), F.col("budget").alias("b"), "top")
    sizes = s.groupBy("tract").agg(F.count("*").alias("all")).select(F.col("tract").alias("ts"), "all")
    g = s.join(sizes, F.col("tract").eqNullSafe(F.col("ts"))).withColumn("budget", F.explode(budgets)).withColumn("n", F.least("budget", "all"))
    p, n, total = F.col("p"), F.min("n"), F.count("*")
    g = g.groupBy("tract", "budget").agg(
        (n * F.avg(p)).alias("expected"), F.sum(p).alias("census"), (n / total * F.sum(p)).alias("srs"), F.sum(1 - F.pow(1 - p / F.col("all"), F.col("n"))).alias("iid"),
        (1 - F.pow(1 - 1 / total, n)).alias("coverage_iid"), F.sum(1 - F.pow(1 - p, F.lit(2))).alias("two_pass"), (0.73 * F.sum(p)).alias("repeats"),
        (0.73 * F.sum(p * p)).alias("repeat_hits"), (F.sqrt(F.sum(p * (1 - p))) / total).alias("se_census"), F.sqrt(F.avg(p) * (1 - F.avg(p)) / n).alias("se_sample"), (total * F.log(1 / (1 - F.lit(0.95)))).alias("iid_budget_95"),
    )
    g = g.join(best, F.col("tract").eqNullSafe(F.col("t")) & (F.col("budget") == F.col("b")))
    at = {"coverage_iid": 6, "se_census": 6, "se_sample": 6, "iid_budget_95": 4}
    rounded = [F.round(c, at.get(c, 5)).alias(c) for c in ("expected", "census", "srs", "iid", "coverage_iid", "two_pass", "repeats", "repeat_hits", "se_census", "se_sample", "iid_budget_95")]
    return g.select("tract", "budget", *rounded, F.round("top", 5).alias("targeted"), F.round(F.least(F.col("top"), 1.5 * F.col("expected")), 5).alias("discounted"))


def least_budget(p: DataFrame, target: float, most: int) -> int | None:
    """The least n of draws with replacement that find ``target`` distinct violators; null beyond ``most``.

    Each round tries 32 budgets in one aggregation, so a few jobs do for any range.
    """
    n_all, lo, hi = p.count(), 0, most
    found = lambda n: F.sum(1 - F.pow(1 - F.col("p") / n_all, F.lit(float(n))))
    if n_all == 0 or p.agg(found(most).alias("x")).first()["x"] < target:
        return None
    while hi - lo > 1:
        tries = sorted({lo + max(1, (hi - lo) * k // 33) for k in range(1, 33)})
        row = p.agg(*[found(n).alias(str(n)) for n in tries]).first()
        lo, hi = max([lo, *(n for n in tries if row[str(n)] < target)]), min([hi, *(n for n in tries if row[str(n)] >= target)])
    return hi


@query(
    "cp5_iid_budget",
    f"WITH {STORES}, t AS (SELECT count(*) AS n_all, sum(p) AS census FROM stores), c AS (SELECT m.n, sum(1 - pow(1 - p / n_all, m.n)) AS found FROM stores, t, (SELECT unnest(range(1, 3 * (SELECT n_all FROM t))) AS n) m GROUP BY m.n) SELECT n_all, min(n) AS budget, round(0.5 * census, 4) AS target FROM c, t WHERE found >= 0.5 * census GROUP BY n_all, census",
)
def iid_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with replacement that find half of all violators."""
    p = settled(stores(spark, sf_dir).select("p"))  # read by a few jobs
    row = p.agg(F.count("*").alias("n"), F.sum("p").alias("s")).first()
    n = least_budget(p, 0.5 * row["s"], 50 * row["n"])
    return p.agg(F.count("*").alias("n_all"), F.lit(n).cast("bigint").alias("budget"), F.round(0.5 * F.sum("p"), 4).alias("target"))


#: Rows (an id each) up to which the stores that a simulation targets are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Stores whose place and outcome (24 bytes) are broadcast to the draws of a bootstrap; beyond it all draws are shuffled.
PLACED_ROWS = 2_000_000
#: Simulations, and the share of all stores that one checks.
_SIMS, _SHARE = 1000, 15
_DRAWS = f"(SELECT greatest(round_even(n / {_SHARE}.0::DOUBLE, 0), 1) FROM n)"


@query(
    "cp6_simulate_capture",
    f"""WITH {STORES}, sims AS (SELECT unnest(range({_SIMS})) AS sim), n AS (SELECT count(*) AS n FROM stores),
 q AS (SELECT tract, count(*) AS k, {_DRAWS} * count(*) / CAST((SELECT n FROM n) AS DOUBLE) AS exact FROM stores GROUP BY tract), q2 AS (SELECT tract, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, tract) AS place FROM q), quota AS (SELECT tract, base + CASE WHEN place <= {_DRAWS} - (SELECT sum(base) FROM q2) THEN 1 ELSE 0 END AS quota FROM q2),
 ss AS (SELECT sim, store, tract, p, CASE WHEN {uniform_sql('hit', 'sim', 'store')} < p THEN 1 ELSE 0 END AS hit, {uniform_sql('srs', 'sim', 'store')} AS u FROM stores, sims),
 rk AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY u, store) AS r, row_number() OVER (PARTITION BY sim ORDER BY p DESC, store) AS rp, row_number() OVER (PARTITION BY sim, tract ORDER BY u, store) AS rt FROM ss),
 iid AS (SELECT sim, CAST(floor({uniform_sql('iid', 'sim', 'j')} * (SELECT n FROM n)) AS BIGINT) AS store FROM sims, (SELECT unnest(range(CAST({_DRAWS} AS BIGINT))) AS j)),
 ev AS (SELECT 'srs' AS policy, sim, store, hit FROM rk WHERE r <= {_DRAWS} UNION ALL SELECT 'targeted', sim, store, hit FROM rk WHERE rp <= {_DRAWS} UNION ALL SELECT 'stratified', sim, store, hit FROM rk JOIN quota USING (tract) WHERE rt <= quota UNION ALL SELECT 'census', sim, store, hit FROM ss UNION ALL SELECT 'iid', sim, store, hit FROM iid JOIN ss USING (sim, store)),
 pe AS (SELECT policy, sim, sum(hit) AS events, count(DISTINCT CASE WHEN hit = 1 THEN store END) AS found, count(DISTINCT store) AS seen FROM ev GROUP BY ALL)
 SELECT policy, round(avg(events), 5) AS events, round(avg(found), 5) AS found, round(avg(seen) / (SELECT n FROM n), 6) AS coverage, round(stddev_pop(found), 5) AS sd FROM pe GROUP BY policy""",
)
def simulate_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monte Carlo capture of five sampling schemes, 1,000 simulations of checks at a fifteenth of the stores."""
    s = settled(stores(spark, sf_dir).select("store", "tract", "p"))
    n = s.count()
    draws = max(round(n / _SHARE), 1)
    w = Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), "tract")  # one row per tract
    quota = s.groupBy("tract").agg((draws * F.count("*") / F.lit(float(n))).alias("exact")).withColumn("base", F.floor("exact")).withColumn("place", F.row_number().over(w))
    left = quota.agg((draws - F.sum("base")).alias("left"))
    quota = quota.join(F.broadcast(left)).select("tract", (F.col("base") + (F.col("place") <= F.col("left")).cast("int")).alias("quota"))
    sims = settled(replicates(s, _SIMS).select("sim", "store", "tract", (uniform("hit", "sim", "store") < F.col("p")).cast("int").alias("hit"), uniform("srs", "sim", "store").alias("u")))
    best = place_within(s, "p", "store").where(F.col("rn") <= draws).select("store")  # the same in all simulations
    best = F.broadcast(best) if draws <= BROADCAST_ROWS else best
    drawn = {
        "srs": lowest_within(sims.withColumn("k", F.lit(draws)), "u", "store", "k", "sim"),
        "stratified": lowest_within(sims.join(F.broadcast(quota), "tract"), "u", "store", "quota", "sim", "tract"),  # a row per tract
        "targeted": sims.join(best, "store", "left_semi"),
        "census": sims,
    }
    picks = spark.range(_SIMS).select(F.col("id").cast("int").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j"))
    # a store is checked once, but for draws with replacement
    again = picks.select("sim", F.floor(uniform("iid", "sim", "j") * n).cast("bigint").alias("store")).groupBy("sim", "store").agg(F.count("*").alias("k"))
    again = again.join(s.select("store", "p"), "store").withColumn("hit", (uniform("hit", "sim", "store") < F.col("p")).cast("int"))
    per = again.groupBy("sim").agg(F.sum(F.col("k") * F.col("hit")).alias("events"), F.sum("hit").alias("found"), F.count("*").alias("seen")).withColumn("policy", F.lit("iid"))
    for policy, rows in drawn.items():
        per = per.unionByName(rows.groupBy("sim").agg(F.sum("hit").alias("events"), F.sum("hit").alias("found"), F.count("*").alias("seen")).withColumn("policy", F.lit(policy)))
    return per.groupBy("policy").agg(F.round(F.avg("events"), 5).alias("events"), F.round(F.avg("found"), 5).alias("found"), F.round(F.avg("seen") / n, 6).alias("coverage"), F.round(F.stddev_pop("found"), 5).alias("sd"))


@query(
    "tk8_bootstrap_lift",
    f"""WITH {STORES}, s AS (SELECT store, prize, CAST(v36 >= 4 AS INTEGER) AS y FROM stores), n AS (SELECT count(*) AS n FROM s),
 d AS (SELECT b, j, CAST(floor({uniform_sql('boot', 'b', 'j')} * n) AS BIGINT) AS store FROM (SELECT unnest(range(500)) AS b), (SELECT store AS j FROM s), n),
 r AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY prize DESC, s.store, j) <= greatest(round_even(0.1 * (SELECT n FROM n), 0), 1) AS top FROM d JOIN s USING (store)),
 l AS (SELECT b, avg(CASE WHEN top THEN y END) / avg(y) AS lift FROM r GROUP BY b) SELECT count(*) AS replicates, round(quantile_cont(lift, 0.025), 6) AS lo, round(avg(lift), 6) AS mean, round(quantile_cont(lift, 0.975), 6) AS hi FROM l""",
)
def bootstrap_lift(spark: SparkSession, sf_dir: str, replicas: int = 500, wide: float = 12.0) -> DataFrame:
    """Percentile bootstrap of the lift of the top tenth, 500 replicates (TK8, AG21).

    Stores are placed by prize once; a replicate's top tenth are its draws with the first places.  Its last place lies near the tenth of all
    places, so draws before that stretch (``wide`` standard deviations to both sides) and behind it are counts, and only those within are
    told apart by place.  Replicates whose last place lies elsewhere are counted again with all places apart.
    """
    s = settled(stores(spark, sf_dir).select("store", "prize", (F.col("v36") >= 4).cast("int").alias("y")))
    n = s.count()
    top = max(round(0.1 * n), 1)
    placed = settled(place_within(s, "prize", "store", out="place").select("store", "place", "y"))
    placed = F.broadcast(placed) if n <= PLACED_ROWS else placed
    margin = wide * (0.09 * n) ** 0.5 + 1

    def cells(draws: DataFrame, first: float, last: float) -> DataFrame:
        d = draws.withColumn("store", F.floor(uniform("boot", "b", "j") * n).cast("bigint")).join(placed, "store")
        cell = F.when(F.col("place") <= first, 0).when(F.col("place") > last, n + 1).otherwise(F.col("place"))
        return d.groupBy("b", cell.alias("cell")).agg(F.count("*").alias("k"), F.sum("y").alias("v"))

    w = Window.partitionBy("b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    draws = s.select(F.col("store").alias("j"))

    def lifts(counted: DataFrame) -> DataFrame:
        c = counted.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0))).withColumn("in", F.least(F.col("k"), F.greatest(top - F.col("before"), F.lit(0))))
        split = F.max((F.col("in") > 0) & (F.col("in") < F.col("k")) & ((F.col("cell") == 0) | (F.col("cell") == n + 1)))  # a place has one y, a stretch has not
        won = F.when(F.col("in") > 0, F.expr("v * in div k"))
        return c.groupBy("b").agg((F.sum(won) / F.sum("in") / (F.sum("v") / F.sum("k"))).alias("lift"), split.alias("split"))

    per = settled(lifts(settled(cells(replicates(draws, replicas, "b"), top - margin, top + margin))))
    missed = [r["b"] for r in per.where("split").select("b").collect()]
    if missed:  # hardly ever; at most a row per replicate
        again = replicates(draws, replicas, "b").where(F.col("b").isin(missed))
        per = per.where("NOT split").unionByName(lifts(cells(again, 0, n)))
    return per.agg(F.count("*").alias("replicates"), F.round(F.percentile("lift", 0.025), 6).alias("lo"), F.round(F.avg("lift"), 6).alias("mean"), F.round(F.percentile("lift", 0.975), 6).alias("hi"))


@query(
    "ml12_capture_benchmark",
    f"WITH {STORES}, t AS (SELECT tract, sum(prize) AS total FROM stores GROUP BY 1), top AS (SELECT tract, sum(prize) AS top FROM (SELECT tract, prize, row_number() OVER (PARTITION BY tract ORDER BY prize DESC, store) AS rn FROM stores) WHERE rn <= 10 GROUP BY 1), d AS (SELECT tract, sim, prize, row_number() OVER (PARTITION BY tract, sim ORDER BY {uniform_sql('bench', 'sim', 'store')}, store) AS rn FROM stores, (SELECT unnest(range(1000)) AS sim)), c AS (SELECT tract, sim, sum(prize) AS captured FROM d WHERE rn <= 10 GROUP BY ALL) SELECT tract, round(min(top / total), 6) AS top_share, round(avg(captured / total), 6) AS random_mean, round(quantile_cont(captured / total, 0.95), 6) AS random_p95 FROM c JOIN t USING (tract) JOIN top USING (tract) GROUP BY tract",
)
def capture_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of prizes that the best ten stores of a tract hold, against 1,000 random draws of ten."""
    s = stores(spark, sf_dir).select("store", "tract", "prize")
    t = s.groupBy("tract").agg(F.sum("prize").alias("total"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("tract").orderBy(F.desc("prize"), "store"))).where("rn <= 10").groupBy("tract").agg(F.sum("prize").alias("top"))
    d = replicates(s, 1000).withColumn("rn", F.row_number().over(Window.partitionBy("tract", "sim").orderBy(uniform("bench", "sim", "store"), "store"))).where("rn <= 10").groupBy("tract", "sim").agg(F.sum("prize").alias("captured"))
    share = F.col("captured") / F.col("total")
    return d.join(t, "tract").join(top, "tract").groupBy("tract").agg(F.round(F.min(F.col("top") / F.col("total")), 6).alias("top_share"), F.round(F.avg(share), 6).alias("random_mean"), F.round(F.percentile(share, 0.95), 6).alias("random_p95"))


_CYCLE = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER)"


@query(
    "sm1_effective_p",
    f"""WITH {STORES}, hs AS (SELECT DISTINCT {_CYCLE} AS cycle, o_custkey AS store FROM orders), mx AS (SELECT max(cycle) AS last FROM hs),
 c AS (SELECT store, count(*) FILTER (cycle > last - 3) AS recent3, count(*) FILTER (cycle > last - 6) AS recent6 FROM hs, mx GROUP BY store), sh AS (SELECT (SELECT count(*) FROM c WHERE recent6 > 0) / CAST((SELECT count(*) FROM stores) AS DOUBLE) AS seen)
 SELECT store, coalesce(recent3, 0) AS recent3, round(p * pow(0.5::DOUBLE, coalesce(recent3, 0)) * (1 - 0.6::DOUBLE * coalesce(recent6, 0) / 6) * (1 - 0.5::DOUBLE * pow(seen, 2)), 6) AS p_eff FROM stores LEFT JOIN c USING (store), sh""",
)
def effective_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk after checks: own recent checks, own frequency, and how visible checks are overall (SM1, WN14)."""
    cycle = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    hist = table(spark, sf_dir, "orders").select(cycle.alias("cycle"), F.col("o_custkey").alias("store")).distinct()
    last = hist.agg(F.max("cycle").alias("last"))
    c = hist.join(F.broadcast(last)).groupBy("store").agg(F.count_if(F.col("cycle") > F.col("last") - 3).alias("recent3"), F.count_if(F.col("cycle") > F.col("last") - 6).alias("recent6"))
    s = stores(spark, sf_dir).join(c, "store", "left").withColumn("r3", F.coalesce("recent3", F.lit(0))).withColumn("r6", F.coalesce("recent6", F.lit(0)))
    seen = s.agg(F.avg((F.col("r6") > 0).cast("int")).alias("seen"))
    p_eff = F.col("p") * F.pow(F.lit(0.5), F.col("r3")) * (1 - 0.6 * F.col("r6") / 6) * (1 - 0.5 * F.pow("seen", F.lit(2)))
    return s.join(F.broadcast(seen)).select("store", F.col("r3").alias("recent3"), F.round(p_eff, 6).alias("p_eff"))


_ZA, _ZB = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)


@query(
    "sm6_power_table",
    f"WITH b AS (SELECT l_returnflag AS grp, avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) * 0.5 AS p, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, least(1.5 * p, 0.95) AS p2 FROM b) SELECT grp, share, CAST(ceil(p * (1 - p) * pow({_ZA}::DOUBLE / 0.1, 2)) AS BIGINT) AS n_rate, CAST(ceil(pow({_ZA + _ZB}::DOUBLE, 2) * (p2 * (1 - p2) + p * (1 - p)) / pow(p2 - p, 2)) AS BIGINT) AS n_arm, round(ceil(p * (1 - p) * pow({_ZA}::DOUBLE / 0.1, 2)) / (share * n / 7), 6) AS years FROM r, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (1.0::DOUBLE)) s(share)",
)
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample sizes for a rate and for a lift, and years to reach them, by base rates seen in the log."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg((F.avg((F.col("l_linestatus") == "F").cast("double")) * 0.5).alias("p"), F.count("*").alias("n"))
    r = b.withColumn("p2", F.least(1.5 * F.col("p"), F.lit(0.95))).withColumn("share", F.explode(F.array(F.lit(0.2), F.lit(0.4), F.lit(1.0))))
    p, p2 = F.col("p"), F.col("p2")
    n_rate = F.ceil(p * (1 - p) * F.pow(F.lit(_ZA / 0.1), F.lit(2)))
    n_arm = F.ceil(F.pow(F.lit(_ZA + _ZB), F.lit(2)) * (p2 * (1 - p2) + p * (1 - p)) / F.pow(p2 - p, F.lit(2)))
    return r.select("grp", "share", n_rate.alias("n_rate"), n_arm.alias("n_arm"), F.round(n_rate / (F.col("share") * F.col("n") / 7), 6).alias("years"))


#: Simulations and checks per tract of the second pass; stores of a tract that are scored first, and rows that a random rule keeps of a tract, about.
_PASSES, _CHECKS, _FIRST, _SPARE = 300, 10, 64, 80


def best_by_bounds(s: DataFrame, sims: int, k: int, first: int = _FIRST) -> DataFrame:
    """(rule, sim, tract, store, p): the k best stores of each tract by p, by the posterior's mean and by the posterior's prize after the first hits.

    A score is highest if the store was hit.  The ``first`` stores of a tract by that bound are scored in all simulations; where the
    k-th of them does not beat every other store's bound, all stores whose bound reaches it are scored.
    """
    least = F.lit(-1e300)
    mean = lambda hit: (5 * F.col("p") + hit) / 6
    prize = lambda hit: F.col("h") * (5 * F.col("p") + hit) / 6
    bounds = s.select("store", "tract", "p", "h", F.col("p").alias("static"), mean(F.lit(1)).alias("posterior_mean"), prize(F.lit(1)).alias("posterior_prize"))
    bounds = bounds.unpivot(["store", "tract", "p", "h"], ["static", "posterior_mean", "posterior_prize"], "rule", "bound").withColumn("bound", F.coalesce("bound", least))

    def best(rows: DataFrame) -> DataFrame:
        hit = (uniform("first", "sim", "store") < F.col("p")).cast("int")
        score = F.when(F.col("rule") == "static", F.col("p")).when(F.col("rule") == "posterior_mean", mean(hit)).otherwise(prize(hit))
        w = Window.partitionBy("rule", "sim", "tract").orderBy(F.desc("score"), "u", "store")
        return rows.withColumns({"score": score, "u": uniform("pick", "sim", "store")}).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("rule", "sim", "tract", "store", "p", "score")

    own = F.row_number().over(Window.partitionBy("rule", "tract").orderBy(F.desc("bound"), "store"))
    top = settled(bounds.withColumn("place", own).where(F.col("place") <= first + 1))
    tried = settled(best(replicates(top.where(F.col("place") <= first), sims)))
    others = top.where(F.col("place") == first + 1).select(F.col("rule").alias("_rule"), F.col("tract").alias("_tract"), F.col("bound").alias("others"))
    reached = tried.groupBy("rule", "sim", "tract").agg(F.min(F.coalesce("score", least)).alias("reached"))
    same = (F.col("rule") == F.col("_rule")) & F.col("tract").eqNullSafe(F.col("_tract"))
    unsure = settled(reached.join(others, same).where("reached <= others").select("_rule", F.col("sim").alias("_sim"), "_tract", "reached"))
    again = bounds.join(unsure, same & (F.col("bound") >= F.col("reached"))).select("rule", F.col("_sim").alias("sim"), "tract", "store", "p", "h")
    sure = tried.join(unsure, same & (F.col("sim") == F.col("_sim")), "left_anti")
    return sure.unionByName(best(again)).drop("score")


def best_at_random(s: DataFrame, tag: str, sims: int, k: int, spare: int = _SPARE) -> DataFrame:
    """(sim, tract, store, p): the k stores of each tract with the highest draws of ``tag``, per simulation.

    Draws below a limit that some ``spare`` of a tract's stores reach are dropped before any sort; where fewer than k are left, all of the tract's
    stores are looked at.  Limits are compared as hexadecimal digits, which order as the draws do.
    """
    w = Window.partitionBy("sim", "tract").orderBy(F.desc("u"), "store")
    best = lambda rows: rows.withColumn("u", uniform(tag, "sim", "store")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("sim", "tract", "store", "p")
    sizes = s.groupBy("tract").agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(0), F.ceil((1 - spare / F.col("n")) * 4294967296.0)).cast("bigint")
    limits = sizes.select(F.col("tract").alias("_tract"), "n", F.lpad(F.lower(F.hex(limit)), 8, "0").alias("limit"))
    rows = replicates(s.join(limits, F.col("tract").eqNullSafe(F.col("_tract"))).select("store", "tract", "p", "limit"), sims)
    tried = settled(best(rows.where(uniform_digits(tag, "sim", "store") >= F.col("limit"))))
    counts = tried.groupBy(F.col("sim").alias("_sim"), F.col("tract").alias("_t")).agg(F.count("*").alias("found"))
    wanted = replicates(limits.select("_tract", "n"), sims, deal=False)
    short = wanted.join(counts, (F.col("sim") == F.col("_sim")) & F.col("_tract").eqNullSafe(F.col("_t")), "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), F.col("n")))
    short = settled(short.select("sim", "_tract"))
    full = best(s.join(short, F.col("tract").eqNullSafe(F.col("_tract"))).select("sim", "store", "tract", "p"))
    sure = tried.join(short.withColumnRenamed("sim", "_sim"), (F.col("sim") == F.col("_sim")) & F.col("tract").eqNullSafe(F.col("_tract")), "left_anti")
    return sure.unionByName(full)


@query(
    "sm9_adaptive_second_pass",
    f"""WITH {STORES}, ss AS (SELECT sim, store, tract, p, h, CASE WHEN {uniform_sql('first', 'sim', 'store')} < p THEN 1 ELSE 0 END AS hit1, CASE WHEN {uniform_sql('second', 'sim', 'store')} < p THEN 1 ELSE 0 END AS hit2, {uniform_sql('pick', 'sim', 'store')} AS u FROM stores, (SELECT unnest(range(300)) AS sim)),
 sc AS (SELECT sim, store, tract, hit1, hit2, u, p AS "static", (5 * p + hit1) / 6 AS posterior_mean, h * (5 * p + hit1) / 6 AS posterior_prize, u AS "random" FROM ss),
 l AS (UNPIVOT sc ON "static", posterior_mean, posterior_prize, "random" INTO NAME rule VALUE score), r AS (SELECT *, row_number() OVER (PARTITION BY rule, sim, tract ORDER BY score DESC, u, store) AS rn FROM l), e AS (SELECT rule, sim, sum(hit2) AS events, sum(hit2 * hit1) AS repeats, sum(hit2 * (1 - hit1)) AS fresh FROM r WHERE rn <= 10 GROUP BY ALL)
 SELECT rule, round(avg(events), 5) AS events, round(avg(repeats), 5) AS repeats, round(avg(fresh), 5) AS fresh, round(stddev_samp(events) / sqrt(count(*)), 5) AS se FROM e GROUP BY rule""",
)
def adaptive_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass of ten checks per tract after a census, by four rules, 300 simulations."""
    s = settled(stores(spark, sf_dir).select("store", "tract", "p", "h"))
    picked = best_by_bounds(s, _PASSES, _CHECKS).unionByName(best_at_random(s, "pick", _PASSES, _CHECKS).withColumn("rule", F.lit("random")))
    hit = lambda tag: (uniform(tag, "sim", "store") < F.col("p")).cast("int")
    e = picked.withColumn("hit1", hit("first")).withColumn("hit2", hit("second")).groupBy("rule", "sim").agg(F.sum("hit2").alias("events"), F.sum(F.col("hit2") * F.col("hit1")).alias("repeats"), F.sum(F.col("hit2") * (1 - F.col("hit1"))).alias("fresh"))
    return e.groupBy("rule").agg(F.round(F.avg("events"), 5).alias("events"), F.round(F.avg("repeats"), 5).alias("repeats"), F.round(F.avg("fresh"), 5).alias("fresh"), F.round(F.stddev_samp("events") / F.sqrt(F.count("*")), 5).alias("se"))


@query(
    "sm9_thompson_second_pass",
    f"WITH {STORES}, f AS (SELECT *, CASE WHEN {uniform_sql('first', '0', 'store')} < p THEN 1 ELSE 0 END AS hit1 FROM stores), g AS (SELECT *, {beta_draw_sql(f'{KAPPA}::DOUBLE * greatest(least(p, 1 - 1e-4), 1e-4) + hit1', f'{KAPPA}::DOUBLE * (1 - greatest(least(p, 1 - 1e-4), 1e-4)) + 1 - hit1', 'second', 'store')} AS draw FROM f), r AS (SELECT tract, hit1, p, row_number() OVER (PARTITION BY tract ORDER BY h * draw DESC, store) AS rn FROM g) SELECT tract, count(*) AS checks, CAST(sum(hit1) AS BIGINT) AS seen_before, round(sum(p), 5) AS expected FROM r WHERE rn <= 10 GROUP BY tract",
)
def thompson_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass by posterior draws, per tract."""
    s = stores(spark, sf_dir).withColumn("hit1", (uniform("first", F.lit(0), "store") < F.col("p")).cast("int"))
    a, b = beta_prior(F.col("p"))
    d = with_beta_draw(s, a + F.col("hit1"), b + 1 - F.col("hit1"), "second", "store")
    w = Window.partitionBy("tract").orderBy(F.desc(F.col("h") * F.col("draw")), "store")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("tract").agg(F.count("*").alias("checks"), F.sum("hit1").alias("seen_before"), F.round(F.sum("p"), 5).alias("expected"))


def shifted(p: Column, slope: Column | float, shift: Column | float) -> Column:
    """sigmoid(slope * logit(p) + shift)."""
    return 1 / (1 + F.exp(-(slope * F.log(p / (1 - p)) + shift)))


def find_shift(df: DataFrame, p: str, target: float, slope: float = 1.0) -> float:
    """The logit shift in -10..10 that brings the mean to the target: Newton steps, kept inside a shrinking bracket.

    Each step is one aggregation of two means; six or so do.
    """
    lo, hi, shift = -10.0, 10.0, 0.0
    for _ in range(30):
        q = shifted(F.col(p), F.lit(slope), F.lit(shift))
        row = df.agg(F.avg(q).alias("mean"), F.avg(q * (1 - q)).alias("rise")).first()
        gap = row["mean"] - target
        lo, hi = (shift, hi) if gap < 0 else (lo, shift)
        if abs(gap) < 1e-10 or hi - lo < 1e-10:
            break
        step = shift - gap / max(row["rise"], 1e-12)
        shift = step if lo < step < hi else (lo + hi) / 2
    return shift


@query("ml7_calibrated_rate", f"WITH {STORES} SELECT count(*) AS n, 0.26::DOUBLE AS mean_p, round(avg(p), 6) AS mean_raw, 1.0::DOUBLE AS same_order FROM stores")
def calibrated_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks shifted on the logit scale to a population rate of 26 %; the order of stores stays."""
    s = stores(spark, sf_dir).select("p")
    out = s.withColumn("q", shifted(F.col("p"), 1.0, find_shift(s, "p", 0.26)))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("q"), 5).alias("mean_p"), F.round(F.avg("p"), 6).alias("mean_raw"), F.round(F.corr(F.log(F.col("p") / (1 - F.col("p"))), F.log(F.col("q") / (1 - F.col("q")))), 6).alias("same_order"))


def find_shifts(df: DataFrame, p: str, target: float, slopes: list[float]) -> list[float]:
    """For each slope the logit shift that brings the mean to the target: Newton steps for all slopes at once.

    Each step is one aggregation over df, whatever the number of slopes.
    """
    lo, hi, shift = [-20.0] * len(slopes), [20.0] * len(slopes), [0.0] * len(slopes)
    for _ in range(30):
        qs = [shifted(F.col(p), F.lit(a), F.lit(b)) for a, b in zip(slopes, shift, strict=True)]
        row = df.agg(*[F.avg(q).alias(f"m{k}") for k, q in enumerate(qs)], *[F.avg(q * (1 - q)).alias(f"r{k}") for k, q in enumerate(qs)]).first()
        gaps = [row[f"m{k}"] - target for k in range(len(slopes))]
        if max(map(abs, gaps)) < 1e-10:
            break
        for k, gap in enumerate(gaps):
            lo[k], hi[k] = (shift[k], hi[k]) if gap < 0 else (lo[k], shift[k])
            step = shift[k] - gap / max(row[f"r{k}"], 1e-12)
            shift[k] = step if lo[k] < step < hi[k] else (lo[k] + hi[k]) / 2
    return shift


def slope_of_lift(s: DataFrame, target: float, share: float = 0.1, rounds: int = 3, tries: int = 16) -> tuple[float, float]:
    """The slope in 0..1 of a truth in which the top share by p has the target lift, and the lift there (the nearest that there is).

    Lift rises with the slope, so each round narrows a grid of slopes; all of them take one aggregation at a time.
    """
    cut = s.agg(F.percentile_approx("p", 1 - share, F.lit(100_000)).alias("c")).first()["c"]
    mean, lo, hi = s.agg(F.avg("p").alias("m")).first()["m"], 0.0, 1.0
    for _ in range(rounds):
        slopes = [lo + (hi - lo) * k / tries for k in range(tries + 1)]
        qs = [shifted(F.col("p"), F.lit(a), F.lit(b)) for a, b in zip(slopes, find_shifts(s, "p", mean, slopes), strict=True)]
        row = s.agg(*[(F.avg(F.when(F.col("p") >= cut, q)) / F.avg(q)).alias(f"l{k}") for k, q in enumerate(qs)]).first()
        lifts = [row[f"l{k}"] for k in range(tries + 1)]
        below = max([k for k, x in enumerate(lifts) if x <= target], default=0)
        lo, hi = slopes[below], slopes[min(below + 1, tries)]
    return slopes[below], lifts[below]


@query("sm8_realized_lift")
def realized_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of a truth whose top tenth by the model's risk has a lift of 1.47 (SM8)."""
    s = settled(stores(spark, sf_dir).select("p"))
    slope, lift = slope_of_lift(s, 1.47)
    return s.agg(F.count("*").alias("n"), F.round(F.lit(lift), 3).alias("lift"), F.round(F.lit(slope), 4).alias("slope"))
