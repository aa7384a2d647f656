"""Projections: names, addresses, keys, scores and labels, as column expressions inside one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions import text as T
from sparkwarden.functions.stats import place_within
from sparkwarden.plans.registry import query
from sparkwarden.sources.tables import LICENCES, POINTS_SQL, STORES, licences, points, stores, table

_NORM = "regexp_replace(upper(trim({c})), '\\s+', ' ', 'g')"
_ADDR = "trim(regexp_replace(regexp_replace(" + _NORM + ", '[.,]', '', 'g'), '\\s+', ' ', 'g'))"
_ZIP = "nullif(regexp_extract({c}, '([0-9]{{5}})', 1), '')"
_WORDS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.ADDRESS_WORDS.items()) + "}"
MATCH_SQL = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(" + _ADDR + ", '#', ' ', 'g'), '\\s+(STE|SUITE|UNIT|APT|FL|FLOOR|RM|ROOM)\\b.*$', ''), '\\s+'), lambda t: t <> ''), lambda t: coalesce(" + _WORDS.replace("{", "{{").replace("}", "}}") + "[t], t)), ' ')"
KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(upper({c}), '[#0-9]+', ' ', 'g'), '[^A-Z& ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "fn5_location_keys",
    f"WITH {LICENCES} SELECT licence, {_NORM.format(c='name')} AS name, {_ADDR.format(c='street')} || '|' || {_ZIP.format(c='zip')} AS location_key, {_NORM.format(c='name')} || '|' || {_ADDR.format(c='street')} || '|' || {_ZIP.format(c='zip')} AS entity_key FROM licences",
)
def location_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised name, location key and entity key of each licence (FN1, FN2, FN4, FN5)."""
    key = T.location_key(F.col("street"), F.col("zip"))
    return licences(spark, sf_dir).select("licence", T.normalize_text(F.col("name")).alias("name"), key.alias("location_key"), F.concat(T.normalize_text(F.col("name")), F.lit("|"), key).alias("entity_key"))


@query("fn3_match_address", f"WITH {LICENCES} SELECT licence, {MATCH_SQL.format(c='street')} AS address, {KEY_SQL.format(c='name')} AS chain, trim(regexp_replace(regexp_replace(upper(name), '{T.NAME_NOISE}', ' ', 'g'), '\\s+', ' ', 'g')) AS tokens FROM licences")
def match_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses for matching, chain names and name tokens (FN3, FN6, FN7)."""
    return licences(spark, sf_dir).select("licence", T.match_address(F.col("street")).alias("address"), T.name_key(F.col("name")).alias("chain"), T.name_tokens(F.col("name")).alias("tokens"))


@query(
    "fn8_name_similarity",
    f"WITH {LICENCES} SELECT licence, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS similarity FROM (SELECT l.licence, upper(trim(l.name)) AS a, upper(trim(c_name)) AS b FROM licences l JOIN customer ON c_custkey = licence)",
)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of a licence's two names."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("licence"), "c_name")
    names = licences(spark, sf_dir).join(own, "licence")
    return names.select("licence", F.round(T.similarity(F.upper(F.trim("name")), F.upper(F.trim("c_name"))), 6).alias("similarity"))


_PAIRS = f"WITH {LICENCES} SELECT l.licence, upper(trim(l.name)) AS a, upper(trim(c_name)) AS b FROM licences l JOIN customer ON c_custkey = licence"


@query("fn8_sequence_ratio", T.sequence_ratio_sql(_PAIRS, "licence"))
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of matching blocks of a licence's two names, by column functions alone (FN8)."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("licence"), "c_name")
    names = licences(spark, sf_dir).join(own, "licence")
    return names.select("licence", F.round(T.sequence_ratio(F.upper(F.trim("name")), F.upper(F.trim("c_name"))), 6).alias("ratio"))


@query("fn9_classify_outlet", f"WITH {LICENCES} SELECT licence, {T.classify_outlet_sql('name')} AS outlet_type FROM licences")
def classify_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlet type of each licence by its name."""
    return licences(spark, sf_dir).select("licence", T.classify_outlet(F.col("name")).alias("outlet_type"))


@query(
    "fn10_fiscal_year",
    "SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fy, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed, regexp_matches(o_orderpriority, 'URGENT|HIGH') AS pressing, substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || CAST(o_custkey AS VARCHAR)), 1, 10) AS licence_id FROM orders",
)
def fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years from October, recoded labels, and hashed ids (FN10, FN11, FN26)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        (F.year("o_orderdate") + (F.month("o_orderdate") >= 10).cast("int")).alias("fy"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("closed"),
        F.coalesce(F.col("o_orderpriority").rlike("URGENT|HIGH"), F.lit(False)).alias("pressing"),
        F.substring(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_custkey").cast("string"))), 1, 10).alias("licence_id"),
    )


def proximity_score(nearest: Column, within: Column, scale: float, most: int) -> Column:
    """Half decay with distance, half count of sites near by; unknown is far away and none."""
    return 0.5 * F.exp(-F.coalesce(nearest, F.lit(1e6)) / scale) + 0.5 * F.least(F.coalesce(within, F.lit(0)), F.lit(most)) / most


def unit_scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` scaled to 0..1 by its range over all rows: one aggregate row, joined back."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def shrunk(df: DataFrame, share: str, moe: str, out: str) -> DataFrame:
    """Empirical-Bayes shrinkage of a share towards its median, by its margin of error."""
    med = df.agg(F.percentile(share, 0.5).alias("_m"), F.percentile(moe, 0.5).alias("_moe"), F.var_pop(share).alias("_var"))
    rows = df.join(F.broadcast(med)).withColumn("_se2", F.pow(F.coalesce(moe, "_moe") / 1.645, F.lit(2)))
    tau = rows.agg(F.greatest(F.max("_var") - F.avg(F.when(F.col(share).isNotNull(), F.col("_se2"))), F.lit(1e-4)).alias("_tau"))
    rows = rows.join(F.broadcast(tau))
    own = F.col("_m") + F.col("_tau") / (F.col("_tau") + F.col("_se2")) * (F.coalesce(share, "_m") - F.col("_m"))
    return rows.withColumn(out, own).drop("_m", "_moe", "_var", "_se2", "_tau")


_SHARE = "CASE WHEN store % 11 = 0 THEN NULL ELSE h * 0.5 END AS share, CASE WHEN store % 7 = 0 THEN NULL ELSE 0.02 + 0.1 * p END AS moe"
_SHRUNK = f"""sh AS (SELECT *, {_SHARE} FROM stores), md AS (SELECT quantile_cont(share, 0.5) AS m, quantile_cont(moe, 0.5) AS mm, var_pop(share) AS v FROM sh),
 se AS (SELECT sh.*, m, v, pow(coalesce(moe, mm) / 1.645::DOUBLE, 2) AS se2 FROM sh, md), ta AS (SELECT greatest(max(v) - avg(CASE WHEN share IS NOT NULL THEN se2 END), 1e-4) AS tau FROM se),
 shrunk AS (SELECT se.*, m + tau / (tau + se2) * (coalesce(share, m) - m) AS youth_raw FROM se, ta)"""


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with site, youth, severity, their weighted exposure and prize (FN13 to FN18)."""
    rows = stores(spark, sf_dir).withColumn("share", F.when(F.col("store") % 11 != 0, F.col("h") * 0.5)).withColumn("moe", F.when(F.col("store") % 7 != 0, 0.02 + 0.1 * F.col("p")))
    rows = unit_scaled(shrunk(rows, "share", "moe", "youth_raw"), "youth_raw", "youth")
    nearest = F.when(F.col("store") % 13 != 0, F.col("h") * 2000)
    site = 0.7 * proximity_score(nearest, F.col("v36"), 300.0, 3) + 0.3 * proximity_score(F.col("h") * 900, F.col("v36") + 1, 150.0, 5)
    severity = F.least(F.col("v36") * 2.0, F.lit(8.0)) / 8
    rows = rows.withColumn("site", site).withColumn("severity", severity).withColumn("exposure", 0.4 * F.col("site") + 0.3 * F.col("youth") + 0.3 * F.col("severity"))
    return rows.withColumn("prize2", F.col("exposure") * F.col("p") + 0.25 * F.col("det"))


@query(
    "fn17_exposure_prize",
    f"""WITH {STORES}, {_SHRUNK}, rg AS (SELECT min(youth_raw) AS lo, max(youth_raw) AS hi FROM shrunk),
 f AS (SELECT store, p, det, CASE WHEN hi = lo THEN 0 ELSE (youth_raw - lo) / (hi - lo) END AS youth, least(v36 * 2.0::DOUBLE, 8) / 8 AS severity,
 0.7::DOUBLE * (0.5::DOUBLE * exp(-coalesce(CASE WHEN store % 13 <> 0 THEN h * 2000 END, 1e6) / 300) + 0.5::DOUBLE * least(v36, 3) / 3) + 0.3::DOUBLE * (0.5::DOUBLE * exp(-(h * 900) / 150) + 0.5::DOUBLE * least(v36 + 1, 5) / 5) AS site FROM shrunk, rg)
 SELECT store, round(site, 6) AS site, round(youth, 6) AS youth, severity, round(0.4::DOUBLE * site + 0.3::DOUBLE * youth + 0.3::DOUBLE * severity, 6) AS exposure, round((0.4::DOUBLE * site + 0.3::DOUBLE * youth + 0.3::DOUBLE * severity) * p + 0.25 * det, 6) AS prize FROM f""",
)
def exposure_prize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure components and prize of each store."""
    e = exposure(spark, sf_dir)
    return e.select("store", F.round("site", 6).alias("site"), F.round("youth", 6).alias("youth"), "severity", F.round("exposure", 6).alias("exposure"), F.round("prize2", 6).alias("prize"))


@query(
    "fn21_reasons",
    f"WITH {STORES} SELECT store, concat_ws('; ', CASE WHEN v36 >= 1 THEN v36 || ' violations in 36 months' END, CASE WHEN days_since >= 365 THEN 'no check for a year' END, CASE WHEN p >= 0.3 THEN 'risk ' || CAST(CAST(round_even(p * 100, 0) AS INTEGER) AS VARCHAR) || '%' END, CASE WHEN h >= 0.8 THEN 'near schools' END) AS reasons FROM stores",
)
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a store is on the list: phrases that apply, joined."""
    phrases = [
        F.when(F.col("v36") >= 1, F.format_string("%d violations in 36 months", "v36")),
        F.when(F.col("days_since") >= 365, "no check for a year"),
        F.when(F.col("p") >= 0.3, F.concat(F.lit("risk "), F.bround(F.col("p") * 100, 0).cast("int").cast("string"), F.lit("%"))),
        F.when(F.col("h") >= 0.8, "near schools"),
    ]
    return stores(spark, sf_dir).select("store", F.concat_ws("; ", *phrases).alias("reasons"))


def proportion_moe(part: Column, whole: Column, part_moe: Column, whole_moe: Column) -> Column:
    """Margin of error of part / whole; where the radicand is negative, that of a ratio."""
    share = F.try_divide(part, whole)
    inner = F.pow(part_moe, F.lit(2)) - F.pow(share, F.lit(2)) * F.pow(whole_moe, F.lit(2))
    other = F.pow(part_moe, F.lit(2)) + F.pow(share, F.lit(2)) * F.pow(whole_moe, F.lit(2))
    return F.try_divide(F.sqrt(F.when(inner >= 0, inner).otherwise(other)), whole)


@query(
    "fn22_margins_of_error",
    """WITH e AS (SELECT user_id, sum(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE)) AS total, sum(CASE WHEN event_type = 'error' THEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) ELSE 0 END) AS part, sqrt(sum(value * value)) AS total_moe, sqrt(sum(CASE WHEN event_type = 'error' THEN value * value ELSE 0 END)) AS part_moe FROM events GROUP BY user_id),
 r AS (SELECT *, part / nullif(total, 0) AS share FROM e)
 SELECT user_id, total, part, round(part_moe, 6) AS part_moe, round(sqrt(CASE WHEN part_moe * part_moe - share * share * total_moe * total_moe >= 0 THEN part_moe * part_moe - share * share * total_moe * total_moe ELSE part_moe * part_moe + share * share * total_moe * total_moe END) / nullif(total, 0), 6) AS share_moe, part_moe > 0.5 * part AS unreliable FROM r""",
)
def margins_of_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from nested JSON, root-sum-square margins, margins of shares, and the unreliable flag."""
    k = F.get_json_object("props", "$.k").cast("double")
    bad = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(k).alias("total"), F.sum(F.when(bad, k).otherwise(0.0)).alias("part"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("total_moe"), F.sqrt(F.sum(F.when(bad, F.col("value") * F.col("value")).otherwise(0.0))).alias("part_moe"))
    return e.select("user_id", "total", "part", F.round("part_moe", 6).alias("part_moe"), F.round(proportion_moe(F.col("part"), F.col("total"), F.col("part_moe"), F.col("total_moe")), 6).alias("share_moe"), (F.col("part_moe") > 0.5 * F.col("part")).alias("unreliable"))


def haversine_minutes(lon1: Column, lat1: Column, lon2: Column, lat2: Column, circuity: float = 1.35, kmh: float = 25.0) -> Column:
    """Driving minutes by great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * 6371.0088 * F.asin(F.sqrt(a)) * circuity / kmh * 60


@query(
    "fn23_haversine_minutes",
    f"WITH {POINTS_SQL}, g AS (SELECT id, -80 + x / 10000 AS lon, 40.44 + y / 10000 AS lat FROM points) SELECT id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - 40.4372) / 2), 2) + cos(radians(40.4372)) * cos(radians(lat)) * pow(sin(radians(lon + 79.9972) / 2), 2))) * 1.35 / 25 * 60, 6) AS minutes FROM g",
)
def depot_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes from the depot to each point."""
    g = points(spark, sf_dir).select("id", (-80 + F.col("x") / 10000).alias("lon"), (40.44 + F.col("y") / 10000).alias("lat"))
    return g.select("id", F.round(haversine_minutes(F.lit(-79.9972), F.lit(40.4372), F.col("lon"), F.col("lat")), 6).alias("minutes"))


def utm(lon: Column, lat: Column, zone: int = 17) -> tuple[Column, Column]:
    """Easting and northing on the GRS80 ellipsoid, by the transverse Mercator series to third order in n."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(alpha, 1):
        east = east + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def _utm_sql(zone: int = 17) -> str:
    """The same series over a table g (id, lon, lat) as DuckDB SQL."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    terms = lambda x, hyper: " + ".join(f"{k!r}::DOUBLE * {x}({2 * j} * xi) * {hyper}({2 * j} * eta)" for j, k in enumerate(alpha, 1))
    return f"""u AS (SELECT id, radians(lon - {zone * 6 - 183}) AS lam, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM g),
 v AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u)
 SELECT id, round(500000 + {0.9996 * radius!r}::DOUBLE * (eta + {terms('cos', 'sinh')}), 3) AS easting, round({0.9996 * radius!r}::DOUBLE * (xi + {terms('sin', 'cosh')}), 3) AS northing FROM v"""


@query("fn24_project_utm", f"WITH {POINTS_SQL}, g AS (SELECT id, -80 + x / 10000 AS lon, 40.44 + y / 10000 AS lat FROM points), {_utm_sql()}")
def project_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points projected to UTM zone 17 north."""
    g = points(spark, sf_dir).select("id", (-80 + F.col("x") / 10000).alias("lon"), (40.44 + F.col("y") / 10000).alias("lat"))
    east, north = utm(F.col("lon"), F.col("lat"))
    return g.select("id", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query(
    "fn25_display_labels",
    "SELECT n_name AS tract, count(*) AS n, format('{:,}', count(*)) AS stores, '$' || format('{:,.0f}', round_even(sum(c_acctbal), 0)) AS dollars, format('{:.1f}%', 100.0 * count(*) FILTER (c_acctbal < 0) / count(*)) AS below FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as readers see them."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    g = c.groupBy(F.col("n_name").alias("tract")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"), F.count_if(F.col("c_acctbal") < 0).alias("b"))
    return g.select("tract", "n", F.format_number("n", 0).alias("stores"), F.concat(F.lit("$"), F.format_number(F.bround("s", 0), 0)).alias("dollars"), F.format_string("%.1f%%", 100.0 * F.col("b") / F.col("n")).alias("below"))


@query(
    "wn8_ranks",
    f"WITH {STORES} SELECT store, tract, row_number() OVER (PARTITION BY tract ORDER BY prize DESC, store) AS prize_rank, round((rank() OVER (PARTITION BY tract ORDER BY v36) + (count(*) OVER (PARTITION BY tract, v36) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY tract), 6) AS v36_pct FROM stores",
)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place by prize, and percentile with average ranks, within tracts."""
    placed = place_within(stores(spark, sf_dir).select("store", "tract", "v36", "prize"), "prize", "store", "tract", out="prize_rank")
    # average ranks need counts per value alone
    values = placed.groupBy("tract", "v36").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tract").orderBy("v36").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mid = values.select(F.col("tract").alias("_t"), F.col("v36").alias("_v"), (before + (F.col("n") + 1) / 2).alias("_rank"))
    same = F.col("tract").eqNullSafe(F.col("_t")) & F.col("v36").eqNullSafe(F.col("_v"))
    return placed.join(mid, same).select("store", "tract", F.col("prize_rank"), F.round(F.col("_rank") / F.col("n_all"), 6).alias("v36_pct"))
