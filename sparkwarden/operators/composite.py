"""Composites of the other operators as single plans: the universe of retailers, its review queue, the feature table,
the frontier of budgets with costs, and the diagnostic model of repeat checks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.rng import normal, uniform
from sparkwarden.functions.stats import auc, lowest_within, place_within
from sparkwarden.operators.policy import replicates
from sparkwarden.operators.projections import KEY_SQL
from sparkwarden.operators.relational import first_crossing, lift_at
from sparkwarden.operators.routing import COSTS, SCENARIOS, cost_lines
from sparkwarden.operators.simulation import truth_draws
from sparkwarden.operators.spatial import as_right, point_in_polygon, polygons, within_distance
from sparkwarden.plans.registry import ORACLES, query
from sparkwarden.sources.shared import forget, settled
from sparkwarden.sources.tables import CHECKS, LICENCES, POINTS_SQL, STORES, checks, licences, points, stores, table

#: Metres within which a check's place may be a location, and the likeness of names that it then needs.
NEAR, ALIKE = 75.0, 0.45


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with coordinates of their own, else from the cache (the middle of their area): location, licences, kinds, tract, name, x, y, coord_source."""
    loc = stores(spark, sf_dir).groupBy("location").agg(F.count("*").alias("licences"), F.countDistinct("segment").alias("kinds"), F.min("tract").alias("tract"), F.min("name").alias("name"))
    pts = points(spark, sf_dir)
    cache = pts.groupBy((F.col("label")).alias("area")).agg(F.round(F.avg("x"), 3).alias("mx"), F.round(F.avg("y"), 3).alias("my"))  # a row per area
    own = pts.where("id % 5 <> 0").select(F.col("id").alias("location"), "x", "y")
    rows = loc.withColumn("area", F.col("tract") % 10).join(own, "location", "left").join(F.broadcast(cache), "area", "left")
    source = F.when(F.col("x").isNotNull(), "registered").when(F.col("mx").isNotNull(), "cache").otherwise("none")
    return rows.select("location", "licences", "kinds", "tract", "name", F.coalesce("x", "mx").alias("x"), F.coalesce("y", "my").alias("y"), source.alias("coord_source"))


def matched(spark: SparkSession, sf_dir: str, loc: DataFrame) -> DataFrame:
    """(est, location, tier, dist, ex, ey): each place of checks with its location, by key, else the nearest alike in name."""
    pts = points(spark, sf_dir)
    n = pts.count()
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("est"), F.col("s_name").alias("est_name"), F.col("s_nationkey").alias("tract"), (F.col("s_suppkey") * 3 % max(n, 1)).alias("id"))
    est = sup.join(pts.select("id", F.col("x").alias("ex"), F.col("y").alias("ey")), "id", "left").drop("id")
    keyed = loc.select("tract", (F.col("location") % 50).alias("k"), "location")
    first = est.withColumn("k", F.col("est") % 50).join(keyed, ["tract", "k"]).groupBy("est", "ex", "ey").agg(F.min("location").alias("location"))
    rest = est.join(first.select("est"), "est", "left_anti").select(F.col("est").alias("id"), F.col("ex").alias("x"), F.col("ey").alias("y"), "est_name")
    right = loc.select(F.col("location").alias("id"), "x", "y", "name")
    pairs = within_distance(rest, as_right(right, "name"), NEAR).where(T.similarity(F.col("est_name"), F.col("r_name")) >= ALIKE)
    near = pairs.groupBy(F.col("id").alias("est"), F.col("x").alias("ex"), F.col("y").alias("ey")).agg(F.min(F.struct(F.round("d", 6).alias("d"), "rid")).alias("b"))
    tiers = first.select("est", "location", F.lit(1).alias("tier"), F.lit(None).cast("double").alias("dist"), "ex", "ey")
    return tiers.unionByName(near.select("est", F.col("b.rid").alias("location"), F.lit(2).alias("tier"), F.col("b.d").alias("dist"), "ex", "ey"))


def universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The retailer universe, a row per location, and the matches behind it."""
    loc = settled(located(spark, sf_dir))
    match = settled(matched(spark, sf_dir, loc))
    edges = polygons(spark, sf_dir)
    own = point_in_polygon(loc.select(F.col("location").alias("id"), "x", "y"), edges, 100.0).select(F.col("id").alias("location"), "poly")
    inside = point_in_polygon(match.select(F.col("est").alias("id"), F.col("ex").alias("x"), F.col("ey").alias("y")), edges, 100.0).select(F.col("id").alias("est"), F.col("poly").isNotNull().alias("inside"))
    log = checks(spark, sf_dir).groupBy(F.col("entity").alias("est")).agg(F.count("*").alias("n"), F.sum("y").alias("v"), F.max("day").alias("last"))
    roll = match.join(inside, "est", "left").join(log, "est", "left").groupBy("location").agg(
        F.count("*").alias("establishments"), F.min("tier").alias("tier"), F.sum(F.coalesce("n", F.lit(0))).alias("checks"), F.sum(F.coalesce("v", F.lit(0))).alias("violations"), F.max("last").alias("last_check"), F.bool_or("inside").alias("inside"),
    )
    rows = loc.join(own, "location", "left").join(roll, "location", "left")
    scope = F.when(F.col("poly").isNotNull() | F.coalesce("inside", F.lit(False)), "in_city").otherwise("outside_city")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("establishments", "checks", "violations")]
    return rows.select("location", "licences", "kinds", "tract", "coord_source", "poly", scope.alias("scope"), "tier", *zero, "last_check"), match


_ODD = "count(*) FILTER (CASE WHEN y1 = y2 THEN FALSE ELSE (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1 END) % 2 = 1"
_UNIVERSE = f"""{STORES}, {POINTS_SQL}, {CHECKS}, areas AS (SELECT label, round(avg(x), 3) AS mx, round(avg(y), 3) AS my FROM points GROUP BY label), corner(k, ex, ey) AS (VALUES (0, 120, 0), (1, 60, 104), (2, -60, 104), (3, -120, 0), (4, -60, -104), (5, 60, -104)),
 edge AS (SELECT label AS poly, mx + a.ex AS x1, my + a.ey AS y1, mx + b.ex AS x2, my + b.ey AS y2 FROM areas, corner a JOIN corner b ON b.k = (a.k + 1) % 6),
 grouped AS (SELECT location, count(*) AS licences, count(DISTINCT segment) AS kinds, min(tract) AS tract, min(name) AS name FROM stores GROUP BY location),
 loc AS (SELECT g.*, coalesce(p.x, a.mx) AS x, coalesce(p.y, a.my) AS y, CASE WHEN p.x IS NOT NULL THEN 'registered' WHEN a.mx IS NOT NULL THEN 'cache' ELSE 'none' END AS coord_source FROM grouped g LEFT JOIN points p ON p.id = g.location AND p.id % 5 <> 0 LEFT JOIN areas a ON a.label = g.tract % 10),
 est AS (SELECT s_suppkey AS est, s_name AS est_name, s_nationkey AS tract, x AS ex, y AS ey FROM supplier LEFT JOIN points ON id = s_suppkey * 3 % (SELECT count(*) FROM points)),
 t1 AS (SELECT est, min(location) AS location FROM est JOIN loc ON loc.tract = est.tract AND loc.location % 50 = est.est % 50 GROUP BY est),
 t2 AS (SELECT est, arg_min(location, (round(d, 6), location)) AS location, min(round(d, 6)) AS dist FROM (SELECT e.est, l.location, sqrt(pow(e.ex - l.x, 2) + pow(e.ey - l.y, 2)) AS d FROM est e JOIN loc l ON sqrt(pow(e.ex - l.x, 2) + pow(e.ey - l.y, 2)) <= {NEAR} AND 1 - levenshtein(e.est_name, l.name) / CAST(greatest(length(e.est_name), length(l.name)) AS DOUBLE) >= {ALIKE} WHERE e.est NOT IN (SELECT est FROM t1)) GROUP BY est),
 matches AS (SELECT est, location, 1 AS tier FROM t1 UNION ALL SELECT est, location, 2 FROM t2),
 own AS (SELECT location, min(poly) AS poly FROM (SELECT location, poly, {_ODD.format(x='x', y='y')} AS inside FROM loc, edge GROUP BY ALL) WHERE inside GROUP BY location),
 eown AS (SELECT DISTINCT est FROM (SELECT est, poly, {_ODD.format(x='ex', y='ey')} AS inside FROM est, edge GROUP BY ALL) WHERE inside),
 logs AS (SELECT entity AS est, count(*) AS n, sum(y) AS v, max(day) AS last FROM checks GROUP BY 1),
 roll AS (SELECT location, count(*) AS establishments, min(tier) AS tier, sum(coalesce(n, 0)) AS checks, sum(coalesce(v, 0)) AS violations, max(last) AS last_check, bool_or(est IN (SELECT est FROM eown)) AS inside FROM matches LEFT JOIN logs USING (est) GROUP BY location),
 universe AS (SELECT location, licences, kinds, tract, coord_source, poly, CASE WHEN poly IS NOT NULL OR coalesce(inside, FALSE) THEN 'in_city' ELSE 'outside_city' END AS scope, tier, coalesce(establishments, 0) AS establishments, CAST(coalesce(checks, 0) AS BIGINT) AS checks, CAST(coalesce(violations, 0) AS BIGINT) AS violations, last_check FROM loc LEFT JOIN own USING (location) LEFT JOIN roll USING (location))"""


@query("er1_retailer_universe", f"WITH {_UNIVERSE} SELECT * FROM universe")
def retailer_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per location: licences, coordinates, polygon, scope (its own or inherited from its matches), and its checks (ER1)."""
    return universe(spark, sf_dir)[0]


@query(
    "er1_review_queue",
    f"WITH {_UNIVERSE} SELECT 'unmatched location' AS issue, location, licences AS detail FROM universe WHERE establishments = 0 UNION ALL SELECT 'proximity match', location, establishments FROM universe WHERE tier = 2 UNION ALL SELECT 'multi-license', location, kinds FROM universe WHERE kinds > 1",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person should look at: locations without checks, matches by nearness alone, licences of several kinds (ER1)."""
    u = settled(universe(spark, sf_dir)[0])
    issue = lambda name, when, detail: u.where(when).select(F.lit(name).alias("issue"), "location", F.col(detail).alias("detail"))
    return issue("unmatched location", "establishments = 0", "licences").unionByName(issue("proximity match", "tier = 2", "establishments")).unionByName(issue("multi-license", "kinds > 1", "kinds"))


@query("er1_scope_checks", f"WITH {_UNIVERSE} SELECT scope, fy, count(*) AS n, CAST(sum(y) AS BIGINT) AS violations FROM checks JOIN matches ON est = entity JOIN universe USING (location) GROUP BY ALL")
def scope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched checks by scope and year (ER1)."""
    u, match = universe(spark, sf_dir)
    rows = checks(spark, sf_dir).join(match.select(F.col("est").alias("entity"), "location"), "entity").join(u.select("location", "scope"), "location")
    return rows.groupBy("scope", "fy").agg(F.count("*").alias("n"), F.sum("y").alias("violations"))


@query(
    "er2_feature_table",
    f"""WITH {LICENCES}, {POINTS_SQL}, l AS (SELECT licence, tract, c_acctbal, {T.classify_outlet_sql('name')} AS outlet_type, {KEY_SQL.format(c='name')} AS chain, x, y FROM licences LEFT JOIN points ON id = licence),
 near AS (SELECT l.licence, min(CASE WHEN label IN (5, 6) THEN d END) AS school_m, count(*) FILTER (label IN (5, 6)) AS schools_100, min(CASE WHEN label IN (7, 8) THEN d END) AS park_m, count(*) FILTER (d <= 50 AND id <> licence) AS points_50 FROM (SELECT l.licence, p.id, p.label, sqrt(pow(l.x - p.x, 2) + pow(l.y - p.y, 2)) AS d FROM l JOIN points p ON sqrt(pow(l.x - p.x, 2) + pow(l.y - p.y, 2)) <= 100) l GROUP BY licence),
 c AS (SELECT chain, outlet_type, count(*) AS chain_count FROM l GROUP BY ALL), t AS (SELECT tract, count(*) AS tract_licences, round(avg(c_acctbal), 4) AS tract_balance FROM l GROUP BY 1)
 SELECT l.licence, l.outlet_type, l.chain, chain_count, chain_count >= 3 AS in_chain, round(school_m, 5) AS school_m, coalesce(schools_100, 0) AS schools_100, round(park_m, 5) AS park_m, coalesce(points_50, 0) AS points_50, tract_licences, tract_balance FROM l JOIN c ON c.chain = l.chain AND c.outlet_type = l.outlet_type JOIN t USING (tract) LEFT JOIN near USING (licence)""",
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per licence: outlet type, chain, what lies near by, and its tract (ER2)."""
    pts = points(spark, sf_dir)
    own = licences(spark, sf_dir).select("licence", "tract", "c_acctbal", T.classify_outlet(F.col("name")).alias("outlet_type"), T.name_key(F.col("name")).alias("chain"))
    at = own.select(F.col("licence").alias("id")).join(pts.select("id", "x", "y"), "id")
    pairs = within_distance(at, as_right(pts, "label"), 100.0)
    school, park = F.col("r_label").isin(5, 6), F.col("r_label").isin(7, 8)
    near = pairs.groupBy(F.col("id").alias("licence")).agg(
        F.round(F.min(F.when(school, F.col("d"))), 5).alias("school_m"), F.count_if(school).alias("schools_100"), F.round(F.min(F.when(park, F.col("d"))), 5).alias("park_m"), F.count_if((F.col("d") <= 50) & (F.col("rid") != F.col("id"))).alias("points_50"),
    )
    chains = own.groupBy("chain", "outlet_type").agg(F.count("*").alias("chain_count"))
    tracts = own.groupBy("tract").agg(F.count("*").alias("tract_licences"), F.round(F.avg("c_acctbal"), 4).alias("tract_balance"))
    rows = own.join(chains, ["chain", "outlet_type"]).join(tracts, "tract").join(near, "licence", "left")
    return rows.select("licence", "outlet_type", "chain", "chain_count", (F.col("chain_count") >= 3).alias("in_chain"), "school_m", F.coalesce("schools_100", F.lit(0)).alias("schools_100"), "park_m", F.coalesce("points_50", F.lit(0)).alias("points_50"), "tract_licences", "tract_balance")


# --- frontier with costs -----------------------------------------------------------------------

SHARES = (0.1, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5)
_BASE = {k: v[1] for k, v in COSTS.items()}
_COST = f"(drive * {_BASE['drive_factor']} + (checks + {_BASE['retry_share']} * checks) * (20 + {_BASE['admin_minutes']}) + {_BASE['retry_share']} * checks * 5) / 60 * ({_BASE['supervisor_wage']} + {_BASE['purchaser_wage']}) * {_BASE['fringe']} + ((drive * {_BASE['drive_factor']} + {_BASE['retry_share']} * checks * 5) / 60 * 22 + routes * {_BASE['commute_miles']}) * {_BASE['mileage_rate']} + (checks + {_BASE['retry_share']} * checks) * {_BASE['data_per_check']} + {_BASE['training_fixed']}"


@query(
    "sm10_policy_frontier",
    f"""WITH {STORES}, r AS (SELECT p, row_number() OVER (ORDER BY p DESC, store) AS rp, CAST(count(*) OVER () AS DOUBLE) AS n FROM stores), b AS (SELECT *, round_even(share * n, 0) AS checks, least(round_even(share * n, 0), n) AS k1, greatest(round_even(share * n, 0) - n, 0) AS k2 FROM r, (VALUES {', '.join(f'({x}::DOUBLE)' for x in SHARES)}) s(share)),
 g AS (SELECT share, min(n) AS n, min(checks) AS checks, min(k1) AS k1, min(k2) AS k2, sum(p) AS sp, sum(p * (1 - p)) AS spq, sum(CASE WHEN rp <= k1 THEN p ELSE 0 END) AS t1, sum(CASE WHEN rp <= k2 THEN p ELSE 0 END) AS t2, sum(CASE WHEN rp <= k2 THEN p * (1 - p) ELSE 0 END) AS d2, sum(CASE WHEN rp <= k1 THEN p * (1 - p) ELSE 0 END) AS v1 FROM b GROUP BY share),
 o AS (SELECT 'random' AS policy, share, checks, k1 / n AS coverage, (k1 + k2) / n * sp AS events, k1 / n * sp + k2 / n * spq AS found, sqrt(k1 / n * spq) AS se FROM g UNION ALL SELECT 'targeted', share, checks, k1 / n, t1 + t2, t1 + d2, sqrt(v1) FROM g),
 c AS (SELECT *, ceil(checks / 12) AS routes, checks * 12 AS drive FROM o), d AS (SELECT *, ({_COST}) * (1 + {_BASE['overhead_share']}) AS cost FROM c)
 SELECT policy, share, CAST(checks AS BIGINT) AS checks, round(coverage, 6) AS coverage, round(events, 4) AS events, round(found, 4) AS found, round(se, 5) AS se, round(cost, 2) AS cost, round(cost / nullif(found, 0), 4) AS per_violator FROM d""",
)
def policy_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets below, at and beyond a census, at random and by risk: coverage, detections, distinct violators, error, and base cost (SM10)."""
    s = place_within(stores(spark, sf_dir).select("store", "p"), "p", "store", out="rp", total="n")
    b = s.withColumn("share", F.explode(F.array(*map(F.lit, SHARES)))).withColumn("checks", F.bround(F.col("share") * F.col("n"), 0))
    b = b.withColumn("k1", F.least(F.col("checks"), F.col("n").cast("double"))).withColumn("k2", F.greatest(F.col("checks") - F.col("n"), F.lit(0.0)))
    p, pq = F.col("p"), F.col("p") * (1 - F.col("p"))
    upto = lambda k, x: F.sum(F.when(F.col("rp") <= F.col(k), x).otherwise(0.0))
    g = b.groupBy("share").agg(F.min("n").alias("n"), F.min("checks").alias("checks"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.sum(p).alias("sp"), F.sum(pq).alias("spq"), upto("k1", p).alias("t1"), upto("k2", p).alias("t2"), upto("k2", pq).alias("d2"), upto("k1", pq).alias("v1"))
    out = g.select("share", "checks", F.expr("k1 / n").alias("coverage"), F.expr("inline(array(struct('random' AS policy, (k1 + k2) / n * sp AS events, k1 / n * sp + k2 / n * spq AS found, sqrt(k1 / n * spq) AS se), struct('targeted' AS policy, t1 + t2 AS events, t1 + d2 AS found, sqrt(v1) AS se)))"))
    totals = out.withColumns({"stops": F.col("checks"), "routes": F.ceil(F.col("checks") / 12), "drive": F.col("checks") * 12} | {k: F.lit(v) for k, v in _BASE.items()})
    cost = F.col("labor") + F.col("mileage") + F.col("data") + F.col("training") + F.col("overhead")
    return cost_lines(totals).select("policy", "share", F.col("checks").cast("bigint").alias("checks"), F.round("coverage", 6).alias("coverage"), F.round("events", 4).alias("events"), F.round("found", 4).alias("found"), F.round("se", 5).alias("se"), F.round(cost, 2).alias("cost"), F.round(F.try_divide(cost, F.col("found")), 4).alias("per_violator"))


#: The capped plan that others are held against, and the options: name, policy and share of a census in checks.
CAPPED = ("targeted", 0.1)
OPTIONS = (("census floor", "random", 1.0), ("census floor and second pass", "targeted", 1.25))
#: How much of what a plan finds deters: name, strength and power of the share of violators that it finds.
DETERRENCE = (("none", 0.0, 1.0), ("proportional", 0.25, 1.0), ("early", 0.5, 0.5), ("late", 0.5, 2.0), ("strong", 0.9, 1.0))
#: Fixed value: the yearly award that pays for checks, in dollars.
AWARD = 1159731
_FRONTIER = f"f AS ({ORACLES['sm10_policy_frontier']}), base AS (SELECT * FROM f WHERE policy = '{CAPPED[0]}' AND share = {CAPPED[1]}::DOUBLE), opt AS (SELECT name, f.* FROM f JOIN (VALUES {', '.join(f"('{n}', '{p}', {x}::DOUBLE)" for n, p, x in OPTIONS)}) o(name, policy, share) USING (policy, share))"


def against_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options of the frontier, each with the capped plan's figures; without that row the query fails."""
    f = settled(policy_frontier(spark, sf_dir))  # two policies times seven budgets
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("policy"), F.lit(x).alias("share")) for n, p, x in OPTIONS])
    options = spark.range(1).select(F.inline(named))
    columns = ("checks", "found", "cost", "events", "coverage")
    base = f.where((F.col("policy") == CAPPED[0]) & (F.col("share") == CAPPED[1])).agg(F.count("*").alias("k"), *(F.first(c).alias(f"b_{c}") for c in columns))
    rows = f.join(F.broadcast(options), ["policy", "share"]).join(F.broadcast(base))
    return rows.where(F.coalesce(F.assert_true(F.col("k") == 1, "no row of the capped plan").isNull(), F.lit(False)))


@query("cv8_marginal_cost", f"WITH {_FRONTIER} SELECT name AS option, o.checks, o.cost, o.checks - b.checks AS d_checks, round(o.cost - b.cost, 2) AS d_cost, round((o.cost - b.cost) / nullif(o.checks - b.checks, 0), 4) AS per_check, round(o.found - b.found, 4) AS d_found, round((o.cost - b.cost) / nullif(o.found - b.found, 0), 4) AS per_violator FROM opt o, base b")
def marginal_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the census and its second pass cost beyond the capped plan, a check and a violator (CV8)."""
    d = lambda c: F.col(c) - F.col(f"b_{c}")
    return against_capped(spark, sf_dir).select(F.col("name").alias("option"), "checks", "cost", d("checks").alias("d_checks"), F.round(d("cost"), 2).alias("d_cost"), F.round(F.try_divide(d("cost"), d("checks")), 4).alias("per_check"), F.round(d("found"), 4).alias("d_found"), F.round(F.try_divide(d("cost"), d("found")), 4).alias("per_violator"))


@query(
    "cv9_break_even",
    f"""WITH {_FRONTIER}, t AS (SELECT max(events) AS total FROM f WHERE policy = 'random' AND share = 1), g AS (SELECT o.name, r.response, o.cost - b.cost AS d_cost, b.cost AS b_cost, total, strength * pow(b.found / total, power) AS capped, strength * pow(least(o.found / total, 1), power) AS reached FROM opt o, base b, t, (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in DETERRENCE)}) r(response, strength, power)),
 h AS (SELECT *, 100 * capped / b_cost * d_cost AS required, 100 * (reached - capped) AS achieved, (reached - capped) * total AS prevented FROM g)
 SELECT name AS option, response, round(required, 5) AS required_points, round(achieved, 5) AS achieved_points, CASE WHEN required > 1e-9 THEN round(achieved / required, 5) END AS achieved_over_required, CASE WHEN achieved > 1e-9 THEN round(d_cost / achieved, 3) END AS per_point, CASE WHEN prevented > 1e-9 THEN round(d_cost / prevented, 3) END AS per_prevented FROM h""",
)
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an option's further dollars must buy to match the capped plan, and buy, per assumed deterrence (CV9)."""
    grid = F.array(*[F.struct(F.lit(n).alias("response"), F.lit(a).alias("strength"), F.lit(b).alias("power")) for n, a, b in DETERRENCE])
    f = policy_frontier(spark, sf_dir).where("policy = 'random' AND share = 1").agg(F.max("events").alias("total"))
    g = against_capped(spark, sf_dir).join(F.broadcast(f)).select("*", F.inline(grid)).withColumn("d_cost", F.col("cost") - F.col("b_cost"))
    effect = lambda share: F.col("strength") * F.pow(share, F.col("power"))
    g = g.withColumns({"capped": effect(F.col("b_found") / F.col("total")), "reached": effect(F.least(F.col("found") / F.col("total"), F.lit(1.0)))})
    g = g.withColumns({"required": 100 * F.col("capped") / F.col("b_cost") * F.col("d_cost"), "achieved": 100 * (F.col("reached") - F.col("capped")), "prevented": (F.col("reached") - F.col("capped")) * F.col("total")})
    part = lambda a, b, digits: F.when(F.col(b) > 1e-9, F.round(F.col(a) / F.col(b), digits))
    return g.select(F.col("name").alias("option"), "response", F.round("required", 5).alias("required_points"), F.round("achieved", 5).alias("achieved_points"), part("achieved", "required", 5).alias("achieved_over_required"), part("d_cost", "achieved", 3).alias("per_point"), part("d_cost", "prevented", 3).alias("per_prevented"))


@query(
    "cv10_opportunity_cost",
    f"""WITH {_FRONTIER} SELECT name AS option, m.measure, round(CASE m.measure WHEN 'cost per check' THEN o.cost / o.checks WHEN 'cost per violator' THEN o.cost / o.found WHEN 'checks per violator' THEN o.checks / o.found WHEN 'further cost a check' THEN (o.cost - b.cost) / (o.checks - b.checks) WHEN 'checks against the capped plan' THEN o.checks / CAST(b.checks AS DOUBLE) ELSE (o.cost - b.cost) / {AWARD} END, 5) AS value
 FROM opt o, base b, (VALUES ('cost per check'), ('cost per violator'), ('checks per violator'), ('further cost a check'), ('checks against the capped plan'), ('further cost as a share of the award')) m(measure)""",
)
def opportunity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled measures of what the same money and checks do (CV10, NB9, NB12)."""
    measures = ", ".join(
        ["'cost per check', cost / checks", "'cost per violator', cost / found", "'checks per violator', checks / found", "'further cost a check', (cost - b_cost) / (checks - b_checks)"]
        + ["'checks against the capped plan', checks / b_checks", f"'further cost as a share of the award', (cost - b_cost) / {AWARD}"]
    )
    return against_capped(spark, sf_dir).select(F.col("name").alias("option"), F.expr(f"stack(6, {measures}) AS (measure, v)")).select("option", "measure", F.round("v", 5).alias("value"))


@query("nb14_mean_truth")
def mean_truth(spark: SparkSession, sf_dir: str, draws: int = 300, sigma: float = 0.5) -> DataFrame:
    """The mean of a store's drawn truths beside its modelled probability (SM7, NB14)."""
    q = truth_draws(settled(stores(spark, sf_dir).select("store", "p", F.lit(1.0).alias("w"))), draws, sigma)
    return q.groupBy("store").agg(F.first("p").alias("p"), F.count("*").alias("draws"), F.round(F.avg("q"), 6).alias("mean_truth"), F.round(F.stddev_samp("q"), 6).alias("spread"))


_VARIANT = "v AS (SELECT 'all' AS variant, store, tract FROM stores UNION ALL SELECT 'retail', store, tract FROM stores WHERE segment <> 'MACHINERY'), t AS (SELECT variant, count(*) AS stops, CAST(ceil(count(*) / 12.0) AS BIGINT) AS routes, count(*) * 12.0::DOUBLE AS drive FROM v GROUP BY 1)"
_VARIANT_PARAMS = "par(scenario, " + ", ".join(COSTS) + ") AS (VALUES " + ", ".join("('" + s + "', " + ", ".join(f"{v[k]}::DOUBLE" for v in COSTS.values()) + ")" for k, s in enumerate(SCENARIOS)) + ")"


@query(
    "nb10_all_licence_costs",
    f"WITH {STORES}, {_VARIANT}, {_VARIANT_PARAMS}, c AS (SELECT *, (drive * drive_factor + (stops + retry_share * stops) * (20 + admin_minutes) + retry_share * stops * 5) / 60 * (supervisor_wage + purchaser_wage) * fringe AS labor, ((drive * drive_factor + retry_share * stops * 5) / 60 * 22 + routes * commute_miles) * mileage_rate AS mileage, (stops + retry_share * stops) * data_per_check AS data FROM t, par) SELECT variant, scenario, stops, routes, round((labor + mileage + data + training_fixed) * (1 + overhead_share), 2) AS total FROM c",
)
def all_licence_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census of retailers, and of all licences, in three cost scenarios (NB10)."""
    s = stores(spark, sf_dir)
    both = s.select(F.lit("all").alias("variant")).unionByName(s.where("segment <> 'MACHINERY'").select(F.lit("retail").alias("variant")))
    t = both.groupBy("variant").agg(F.count("*").alias("stops"), F.ceil(F.count("*") / 12).alias("routes"), (F.count("*") * 12.0).alias("drive"))
    some = F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.lit(v[k]).alias(c) for c, v in COSTS.items()]) for k, name in enumerate(SCENARIOS)])
    lines = cost_lines(t.withColumn("s", F.explode(some)).select("variant", "stops", "routes", "drive", "s.*"))
    return lines.select("variant", "scenario", "stops", "routes", F.round(F.col("labor") + F.col("mileage") + F.col("data") + F.col("training") + F.col("overhead"), 2).alias("total"))


@query("nb13_break_even_sigma")
def break_even_sigma(spark: SparkSession, sf_dir: str, sims: int = 100) -> DataFrame:
    """A second pass over a tenth of the stores by the model's risk and by the posterior, as hidden noise grows, and where they break even (NB13, SM9)."""
    s = settled(stores(spark, sf_dir).select("store", "p"))
    k = math.ceil(0.1 * s.count())
    # by the model's risk the same stores are checked in all draws; draws and first checks are the same for all spreads
    s = settled(place_within(s, "p", "store", ends=(0.0, 1.0)).select("store", "p", (F.col("rn") <= k).alias("top"), F.lit(k).alias("k")))
    drawn = settled(replicates(s, sims).select("sim", "store", "p", "top", "k", normal("truth", "sim", "store").alias("z"), uniform("sigma.first", "sim", "store").alias("u")))
    parts = []
    for sigma in (0.0, 0.25, 0.5, 1.0, 1.5):
        q = truth_draws(s, sims, sigma, drawn=drawn).withColumn("posterior", (5 * F.col("p") + (F.col("u") < F.col("q")).cast("int")) / 6)
        static = q.where("top").groupBy("sim").agg(F.sum("q").alias("static"))
        second = lowest_within(q.select("sim", "store", "q", "k", "posterior"), "posterior", "store", "k", "sim", highest=True).groupBy("sim").agg(F.sum("q").alias("posterior"))
        parts.append(settled(static.join(second, "sim").agg(F.lit(sigma).alias("sigma"), F.avg("static").alias("static"), F.avg("posterior").alias("posterior"))))
    forget(drawn)
    parts = reduce(DataFrame.unionByName, parts)
    rows = settled(parts).withColumn("difference", F.col("posterior") - F.col("static")).withColumn("all", F.lit(1))
    return rows.join(first_crossing(rows, "sigma", "difference", "all"), "all").select("sigma", F.round("static", 5).alias("static"), F.round("posterior", 5).alias("posterior"), F.round("difference", 5).alias("difference"), F.round("crossing", 5).alias("break_even"))


# --- repeat checks -----------------------------------------------------------------------------

_REPEAT = """e AS (SELECT event_id, user_id, epoch(ts) AS secs, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events), f AS (SELECT *, row_number() OVER w - 1 AS n_prior, lag(y) OVER w AS prev_y, secs - lag(secs) OVER w AS gap,
 coalesce(sum(y) OVER (PARTITION BY user_id ORDER BY secs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v_prior FROM e WINDOW w AS (PARTITION BY user_id ORDER BY secs, event_id)),
 r AS (SELECT *, (v_prior + 1) / CAST(n_prior + 2 AS DOUBLE) AS rate, secs >= (SELECT (min(secs) + max(secs)) / 2 FROM e) AS test FROM f WHERE n_prior > 0)"""


def repeat_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a prior one: smoothed prior rate, gap, previous outcome, log count, and whether they lie in the later half of the time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "error").cast("int").alias("y"))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    before = F.coalesce(F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = e.select("*", (F.row_number().over(w) - 1).alias("n_prior"), F.lag("y").over(w).alias("prev_y"), (F.col("at") - F.lag("at").over(w)).alias("gap"), before.alias("v_prior")).where("n_prior > 0")
    middle = e.agg(((F.min("at") + F.max("at")) / 2).alias("middle"))
    return f.join(F.broadcast(middle)).withColumn("rate", (F.col("v_prior") + 1) / (F.col("n_prior") + 2)).withColumn("test", F.col("at") >= F.col("middle"))


@query(
    "ml11_repeat_diagnostic",
    f"WITH {_REPEAT}, k AS (SELECT test, y, rank() OVER (PARTITION BY test ORDER BY rate) + (count(*) OVER (PARTITION BY test, rate) - 1) / 2.0::DOUBLE AS rk, row_number() OVER (PARTITION BY test ORDER BY rate DESC, event_id) <= greatest(round_even(0.2 * count(*) OVER (PARTITION BY test), 0), 1) AS top FROM r) SELECT test, count(*) AS n, CAST(sum(y) AS BIGINT) AS violations, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc, round(avg(CASE WHEN top THEN y END) / nullif(avg(y), 0), 6) AS lift FROM k GROUP BY test",
)
def repeat_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the smoothed prior rate ranks repeat checks before and after the split: AUC and lift of the top fifth (ML11)."""
    r = repeat_checks(spark, sf_dir).select("event_id", "test", "y", "rate")
    base = r.groupBy("test").agg(F.count("*").alias("n"), F.sum("y").alias("violations"))
    return base.join(auc(r, "rate", "y", "test"), "test").join(lift_at(r, "rate", "y", 0.2, ["event_id"], "test"), "test").select("test", "n", "violations", F.round("auc", 6).alias("auc"), F.round("lift", 6).alias("lift"))


@query("ml11_repeat_model")
def repeat_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model of the four features, fitted before the split: AUC and lift of the top fifth on both sides (ML11)."""
    rows = settled(repeat_checks(spark, sf_dir).select("event_id", "test", F.col("y").cast("double").alias("y"), "rate", F.log1p("gap").alias("gap"), F.col("prev_y").cast("double").alias("prev_y"), F.log("n_prior").alias("log_n")))
    frame = VectorAssembler(inputCols=["rate", "gap", "prev_y", "log_n"], outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="y", maxIter=50, regParam=1e-4).fit(frame.where("NOT test"))
    scored = model.transform(frame).select("event_id", "test", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
    base = scored.groupBy("test").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))
    return base.join(auc(scored, "p", "y", "test"), "test").join(lift_at(scored, "p", "y", 0.2, ["event_id"], "test"), "test").select("test", "n", "mean_p", "rate", F.round("auc", 4).alias("auc"), F.round("lift", 4).alias("lift"))
