"""Filters, joins, aggregates, windows, top-k and set operations over the inspection views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions.stats import half_even, ntile, place_within, quantile_bucket
from sparkwarden.plans.registry import query
from sparkwarden.sources.tables import CHECKS, LAMBDA, STORES, checks, stores, table


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that fit all filters: {col, values} or {col, min, max}, both ends within, either may lack."""
    for f in filters:
        c = F.col(f["col"])
        if "values" in f:
            df = df.where(c.isin(list(f["values"])))
        else:
            ends = [c.isNotNull()] + ([c >= f["min"]] if f.get("min") is not None else []) + ([c <= f["max"]] if f.get("max") is not None else [])
            for e in ends:
                df = df.where(e)
    return df


@query("fl1_spec_filters", f"WITH {STORES} SELECT store, segment, round(p, 6) AS p, v36 FROM stores WHERE segment IN ('BUILDING', 'MACHINERY') AND p BETWEEN 0.1 AND 0.4 AND v36 >= 2")
def spec_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction of value and range filters."""
    some = apply_filters(stores(spark, sf_dir), [{"col": "segment", "values": ["BUILDING", "MACHINERY"]}, {"col": "p", "min": 0.1, "max": 0.4}, {"col": "v36", "min": 2}])
    return some.select("store", "segment", F.round("p", 6).alias("p"), "v36")


@query("fl2_key_membership", f"WITH {CHECKS} SELECT entity, count(*) AS n FROM checks WHERE entity IN (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1) GROUP BY entity")
def key_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of entities inside one city: a semi join."""
    keys = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("entity"))
    return checks(spark, sf_dir).join(keys, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))


@query("fl3_key_exclusion", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def key_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a closed order: an anti join."""
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(closed, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("fl5_time_split", f"WITH {CHECKS} SELECT fy, fy = 2001 AS test, count(*) AS n, round(avg(y), 6) AS rate FROM checks WHERE up AND fy <= 2001 AND day <= DATE '2001-08-02' GROUP BY fy")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training years and the test year, up to a publication cutoff (FL4, FL5)."""
    log = checks(spark, sf_dir).where(F.col("up") & (F.col("fy") <= 2001) & (F.col("day") <= F.date_sub(F.lit("2001-09-01").cast("date"), 30)))
    return log.groupBy("fy").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate")).withColumn("test", F.col("fy") == 2001)


@query("fl6_scope_filter", f"WITH {STORES} SELECT CASE WHEN tract < 5 THEN 'city' ELSE 'postal' END AS scope, count(*) AS n, count(DISTINCT location) AS locations FROM stores WHERE tract < 12 GROUP BY 1")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores inside the city and in its postal area."""
    inside = stores(spark, sf_dir).where("tract < 12")
    return inside.groupBy(F.when(F.col("tract") < 5, "city").otherwise("postal").alias("scope")).agg(F.count("*").alias("n"), F.countDistinct("location").alias("locations"))


@query("fl7_group_filter", f"WITH {STORES} SELECT location, count(DISTINCT segment) AS n_segments, count(*) AS n FROM stores GROUP BY location HAVING count(DISTINCT segment) > 1")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with licences of more than one kind."""
    return stores(spark, sf_dir).groupBy("location").agg(F.countDistinct("segment").alias("n_segments"), F.count("*").alias("n")).where("n_segments > 1")


@query("fl8_complete_cases", "SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an outer join without gaps in the columns that matter."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.dropna(subset=["quality", "toxic"]).select("doc_id", "quality", "lang", "n_chars")


@query("jn1_universe_features", f"WITH {STORES}, t AS (SELECT o_custkey AS store, count(*) AS checks, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT s.store, n_name AS tract_name, coalesce(checks, 0) AS checks, last FROM stores s LEFT JOIN t USING (store) LEFT JOIN nation ON n_nationkey = s.tract")
def universe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins of stores with their checks and tracts (JN1 to JN3, SRC15)."""
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("store")).agg(F.count("*").alias("checks"), F.max("o_orderdate").alias("last"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tract"), F.col("n_name").alias("tract_name"))
    return stores(spark, sf_dir).join(seen, "store", "left").join(nation, "tract", "left").select("store", "tract_name", F.coalesce("checks", F.lit(0)).alias("checks"), "last")


@query(
    "jn11_full_outer_years",
    "WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, count(*) AS items, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS viol FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT coalesce(a.yr, b.yr) AS yr, coalesce(orders, 0) AS orders, coalesce(items, 0) AS items, round(coalesce(viol, 0) / nullif(CAST(items AS DOUBLE), 0), 6) AS share FROM a FULL JOIN b ON a.yr = b.yr",
)
def full_outer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly series side by side; gaps are zeros."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("orders"))
    b = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.year("l_shipdate").alias("yr")).agg(F.count("*").alias("items"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("viol"))
    both = a.join(b, "yr", "full_outer")
    return both.select("yr", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("items", F.lit(0)).alias("items"), F.round(F.try_divide(F.coalesce("viol", F.lit(0)), F.col("items").cast("double")), 6).alias("share"))


@query("jn13_conditional_fill", "SELECT c_custkey, coalesce(nullif(c_acctbal, least(c_acctbal, 0)), s.m) AS bal, CASE WHEN c_acctbal > 0 THEN 'own' WHEN s.m IS NOT NULL THEN 'cache' ELSE 'none' END AS bal_source FROM customer LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey")
def conditional_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values from a cache, with their origin."""
    cache = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("m"))
    own = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").join(cache, "c_nationkey", "left").select("c_custkey", F.coalesce(own, "m").alias("bal"), F.when(own.isNotNull(), "own").when(F.col("m").isNotNull(), "cache").otherwise("none").alias("bal_source"))


@query(
    "jn14_scope_inheritance",
    f"WITH {STORES}, k AS (SELECT location, max(CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END) AS inside FROM stores WHERE store % 3 <> 0 GROUP BY 1), l AS (SELECT location, min(CASE WHEN store % 3 = 0 AND tract < 20 THEN tract END) AS tract FROM stores GROUP BY 1) SELECT l.location, CASE WHEN l.tract IS NOT NULL THEN CASE WHEN l.tract < 10 THEN 'in_city' ELSE 'outside_city' END WHEN k.inside = 1 THEN 'in_city' ELSE 'outside_city' END AS scope FROM l LEFT JOIN k USING (location)",
)
def scope_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location without a place of its own takes the widest scope of its matched licences."""
    s = stores(spark, sf_dir)
    own = s.groupBy("location").agg(F.min(F.when((F.col("store") % 3 == 0) & (F.col("tract") < 20), F.col("tract"))).alias("tract"), F.max(F.when(F.col("store") % 3 != 0, (F.col("segment") == "BUILDING").cast("int"))).alias("inside"))
    inside = F.when(F.col("tract").isNotNull(), F.col("tract") < 10).otherwise(F.coalesce(F.col("inside") == 1, F.lit(False)))
    return own.select("location", F.when(inside, "in_city").otherwise("outside_city").alias("scope"))


@query(
    "ag2_fiscal_table",
    f"WITH {CHECKS} SELECT fy, count(*) AS records, count(*) FILTER (up) AS up_checks, CAST(sum(CASE WHEN up THEN y ELSE 0 END) AS BIGINT) AS violations, count(*) FILTER (up AND s_nationkey < 5) AS city_checks, round_even(sum(CASE WHEN up THEN y END) / nullif(CAST(count(*) FILTER (up) AS DOUBLE), 0), 3) AS rate, round_even(count(*) FILTER (up AND s_nationkey < 5) / nullif(CAST(count(*) FILTER (up) AS DOUBLE), 0), 3) AS city_share FROM checks JOIN supplier ON s_suppkey = entity GROUP BY fy",
)
def fiscal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conditional aggregation per fiscal year."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_nationkey")
    up, city = F.col("up"), F.col("up") & (F.col("s_nationkey") < 5)
    g = checks(spark, sf_dir).join(s, "entity").groupBy("fy").agg(F.count("*").alias("records"), F.count_if(up).alias("up_checks"), F.sum(F.when(up, F.col("y")).otherwise(0)).alias("violations"), F.count_if(city).alias("city_checks"))
    rate = lambda a: half_even(F.try_divide(F.col(a).cast("double"), F.col("up_checks").cast("double")), 3)
    return g.select("*", rate("violations").alias("rate"), rate("city_checks").alias("city_share"))


@query(
    "ag3_location_summary",
    f"WITH {STORES} SELECT location, arg_max(name, store) AS last_name, array_to_string(list_sort(list_distinct(list(segment))), ' | ') AS kinds, count(*) AS records, CAST(sum(v36) AS BIGINT) AS violations, min(store) AS first_store, max(store) AS last_store, min(days_since) AS recent FROM stores GROUP BY location",
)
def location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per location: the last name, sorted distinct kinds in one string, counts, sums and ends (AG3, SO8)."""
    return stores(spark, sf_dir).groupBy("location").agg(F.max_by("name", "store").alias("last_name"), F.array_join(F.sort_array(F.collect_set("segment")), " | ").alias("kinds"), F.count("*").alias("records"), F.sum("v36").alias("violations"), F.min("store").alias("first_store"), F.max("store").alias("last_store"), F.min("days_since").alias("recent"))


@query(
    "ag4_match_rollup",
    "WITH m AS (SELECT o_custkey AS licence, l_suppkey AS location, CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END AS tier, l_quantity AS dist, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey), b AS (SELECT *, row_number() OVER (PARTITION BY licence, location ORDER BY tier, dist, l_shipdate) AS rn FROM m) SELECT licence, min(tier) AS tier, min(dist) AS dist, count(*) AS locations, min(l_shipdate) AS first, max(l_shipdate) AS last FROM b WHERE rn = 1 GROUP BY licence",
)
def match_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match per (licence, location), rolled up to licences; min over structs needs no sort window."""
    m = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    best = m.groupBy(F.col("o_custkey").alias("licence"), F.col("l_suppkey").alias("location")).agg(F.min(F.struct(F.when(F.col("l_linenumber") <= 2, 1).otherwise(2).alias("tier"), F.col("l_quantity").alias("dist"), "l_shipdate")).alias("b"))
    return best.groupBy("licence").agg(F.min("b.tier").alias("tier"), F.min("b.dist").alias("dist"), F.count("*").alias("locations"), F.min("b.l_shipdate").alias("first"), F.max("b.l_shipdate").alias("last"))


@query("ag5_severity_sum", f"WITH {CHECKS} SELECT entity, sum(CASE outcome WHEN 'WL' THEN 1.0::DOUBLE WHEN 'CMP' THEN 2.0::DOUBLE WHEN 'NTSO' THEN 4.0::DOUBLE ELSE 0 END) AS points, count(DISTINCT part) AS parts FROM checks GROUP BY entity")
def severity_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty points and distinct products per entity (AG5, AG6)."""
    pts = F.coalesce(F.create_map(F.lit("WL"), F.lit(1.0), F.lit("CMP"), F.lit(2.0), F.lit("NTSO"), F.lit(4.0))[F.col("outcome")], F.lit(0.0))
    return checks(spark, sf_dir).groupBy("entity").agg(F.sum(pts).alias("points"), F.countDistinct("part").alias("parts"))


@query("ag6_chain_size", f"WITH {STORES} SELECT store, count(*) OVER (PARTITION BY segment, tract) AS chain_count, count(*) OVER (PARTITION BY segment, tract) >= 3 AS chain FROM stores")
def chain_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stores a chain has, on each of its stores."""
    s = stores(spark, sf_dir).select("store", "segment", "tract")
    n = s.groupBy("segment", "tract").agg(F.count("*").alias("chain_count"))
    return s.join(n, s["segment"].eqNullSafe(n["segment"]) & s["tract"].eqNullSafe(n["tract"])).select("store", "chain_count", (F.col("chain_count") >= 3).alias("chain"))


_COVERAGE = f"{STORES}, seen AS (SELECT o_custkey AS store, count(*) AS inspections FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), coverage AS (SELECT tract, count(*) AS retailers, CAST(sum(coalesce(inspections, 0)) AS BIGINT) AS inspections, count(*) FILTER (inspections > 0) AS inspected, avg(h) AS poverty, avg(p) AS minority, count(*) FILTER (inspections > 0) / CAST(count(*) AS DOUBLE) AS rate FROM stores LEFT JOIN seen USING (store) WHERE tract IS NOT NULL GROUP BY tract)"


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tract: retailers, inspections, stores inspected, shares and coverage rate (AG8)."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("store")).agg(F.count("*").alias("k"))
    rows = stores(spark, sf_dir).join(seen, "store", "left").where("tract IS NOT NULL")
    return rows.groupBy("tract").agg(F.count("*").alias("retailers"), F.sum(F.coalesce("k", F.lit(0))).alias("inspections"), F.count_if(F.col("k") > 0).alias("inspected"), F.avg("h").alias("poverty"), F.avg("p").alias("minority"), (F.count_if(F.col("k") > 0) / F.count("*")).alias("rate"))


@query("ag8_coverage_by_tract", f"WITH {_COVERAGE} SELECT tract, retailers, inspections, inspected, round(poverty, 6) AS poverty, round(rate, 6) AS rate FROM coverage")
def coverage_by_tract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each tract."""
    return coverage(spark, sf_dir).select("tract", "retailers", "inspections", "inspected", F.round("poverty", 6).alias("poverty"), F.round("rate", 6).alias("rate"))


@query(
    "ag9_equity_summary",
    f"WITH {_COVERAGE}, q AS (SELECT quantile_cont(poverty, 0.75) AS q75, quantile_cont(minority, 0.5) AS m50 FROM coverage) SELECT count(*) AS tracts, round(sum(CASE WHEN poverty >= q75 THEN inspections ELSE 0 END) / sum(inspections), 6) AS poor_inspections, round(sum(CASE WHEN poverty >= q75 THEN retailers ELSE 0 END) / sum(retailers), 6) AS poor_retailers, round(corr(poverty, rate), 6) AS poverty_corr, round((sum(CASE WHEN minority > m50 THEN inspected ELSE 0 END) / sum(CASE WHEN minority > m50 THEN retailers ELSE 0 END)) / (sum(CASE WHEN minority <= m50 THEN inspected ELSE 0 END) / sum(CASE WHEN minority <= m50 THEN retailers ELSE 0 END)), 6) AS coverage_ratio FROM coverage, q",
)
def equity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in the poorest quarter of tracts, correlation with poverty, and ratio of coverage between groups (AG9, AG10)."""
    c = coverage(spark, sf_dir)
    ends = c.agg(F.percentile("poverty", 0.75).alias("q75"), F.percentile("minority", 0.5).alias("m50"))
    poor, many = F.col("poverty") >= F.col("q75"), F.col("minority") > F.col("m50")
    part = lambda cond, x: F.sum(F.when(cond, F.col(x)).otherwise(0))
    ratio = F.try_divide(F.try_divide(part(many, "inspected"), part(many, "retailers").cast("double")), F.try_divide(part(~many, "inspected"), part(~many, "retailers").cast("double")))
    return c.join(F.broadcast(ends)).agg(F.count("*").alias("tracts"), F.round(F.try_divide(part(poor, "inspections"), F.sum("inspections").cast("double")), 6).alias("poor_inspections"), F.round(F.try_divide(part(poor, "retailers"), F.sum("retailers").cast("double")), 6).alias("poor_retailers"), F.round(F.corr("poverty", "rate"), 6).alias("poverty_corr"), F.round(ratio, 6).alias("coverage_ratio"))


@query(
    "ag11_equity_compare",
    f"WITH {STORES}, k AS (SELECT o_custkey AS store, o_orderpriority AS regime, count(*) AS k FROM orders GROUP BY ALL), t AS (SELECT regime, tract, count(DISTINCT store) AS inspected FROM k JOIN stores USING (store) GROUP BY ALL), n AS (SELECT tract, count(*) AS retailers FROM stores GROUP BY 1) SELECT regime, count(*) AS tracts, round(avg(least(greatest(1 - inspected / CAST(retailers AS DOUBLE), 0), 1)), 6) AS uncovered, round(min(inspected / CAST(retailers AS DOUBLE)), 6) AS least_rate FROM t JOIN n USING (tract) GROUP BY regime",
)
def equity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by regime over tracts."""
    s = stores(spark, sf_dir)
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderpriority").alias("regime")).distinct()
    t = seen.join(s.select("store", "tract"), "store").groupBy("regime", "tract").agg(F.count("*").alias("inspected"))
    rate = F.col("inspected") / F.col("retailers")
    return t.join(s.groupBy("tract").agg(F.count("*").alias("retailers")), "tract").groupBy("regime").agg(F.count("*").alias("tracts"), F.round(F.avg(F.least(F.greatest(1 - rate, F.lit(0.0)), F.lit(1.0))), 6).alias("uncovered"), F.round(F.min(rate), 6).alias("least_rate"))


@query(
    "ag12_calibration_table",
    f"WITH {STORES}, b AS (SELECT tract, p, v36 >= 3 AS y, CAST(greatest(ceil((row_number() OVER (PARTITION BY tract ORDER BY p, store) - 1) * 5 / CAST(greatest(count(*) OVER (PARTITION BY tract) - 1, 1) AS DOUBLE)) - 1, 0) AS INTEGER) AS bin FROM stores) SELECT tract, bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS INTEGER)), 6) AS observed FROM b GROUP BY ALL",
)
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile bins of predicted risk against what was seen (AG12, WN9)."""
    up = place_within(stores(spark, sf_dir).select("store", "tract", "p", "v36", (-F.col("p")).alias("low")), "low", "store", "tract")
    b = up.withColumn("bin", quantile_bucket(5, F.col("rn"), F.col("n_all")))
    return b.groupBy("tract", "bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg((F.col("v36") >= 3).cast("int")), 6).alias("observed"))


@query("ag13_outlet_effects", f"WITH {STORES} SELECT segment, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(v36 >= 3 AS INTEGER)), 6) AS mean_y, round(stddev_pop(p), 6) AS sd_pop, round(stddev_samp(p), 6) AS sd FROM stores GROUP BY segment")
def outlet_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and spreads per outlet type."""
    return stores(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg((F.col("v36") >= 3).cast("int")), 6).alias("mean_y"), F.round(F.stddev_pop("p"), 6).alias("sd_pop"), F.round(F.stddev_samp("p"), 6).alias("sd"))


@query("ag14_one_row_per_location", f"WITH {STORES} SELECT location, arg_min(name, store) AS name, arg_min(tract, store) AS tract, bool_or(v36 > 0) AS observed, round(max(p), 6) AS p, round(max(h), 6) AS h, round(max(prize), 6) AS prize FROM stores GROUP BY location")
def one_row_per_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with the column-wise largest values of their stores."""
    return stores(spark, sf_dir).groupBy("location").agg(F.min_by("name", "store").alias("name"), F.min_by("tract", "store").alias("tract"), F.bool_or(F.col("v36") > 0).alias("observed"), *[F.round(F.max(c), 6).alias(c) for c in ("p", "h", "prize")])


@query("ag15_tract_summary", f"WITH {STORES} SELECT tract, count(*) AS retailers, round(sum(prize), 4) AS prize_sum, round(avg(prize), 6) AS prize_mean, round(avg(CAST(v36 = 0 AS INTEGER)), 6) AS share_unobserved FROM stores WHERE tract IS NOT NULL GROUP BY tract")
def tract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prizes per tract (AG15, SP6)."""
    return stores(spark, sf_dir).where("tract IS NOT NULL").groupBy("tract").agg(F.count("*").alias("retailers"), F.round(F.sum("prize"), 4).alias("prize_sum"), F.round(F.avg("prize"), 6).alias("prize_mean"), F.round(F.avg((F.col("v36") == 0).cast("int")), 6).alias("share_unobserved"))


@query(
    "ag18_kpis",
    f"WITH {STORES}, k AS (SELECT count(*) AS n, count(DISTINCT location) AS locations, avg(CAST(v36 > 0 AS INTEGER)) AS share, median(p) AS mid FROM stores) SELECT 'stores' AS name, CAST(n AS DOUBLE) AS value FROM k UNION ALL SELECT 'locations', CAST(locations AS DOUBLE) FROM k UNION ALL SELECT 'share observed', round(share, 6) FROM k UNION ALL SELECT 'median p', round(mid, 6) FROM k",
)
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tiles from one aggregation, unpivoted (AG18, AG19, SO6)."""
    one = stores(spark, sf_dir).agg(F.count("*").cast("double").alias("stores"), F.countDistinct("location").cast("double").alias("locations"), F.round(F.avg((F.col("v36") > 0).cast("int")), 6).alias("share observed"), F.round(F.median("p"), 6).alias("median p"))
    return one.unpivot([], list(one.columns), "name", "value")


@query("ag19_funnel", f"WITH {STORES}, f AS (SELECT count(*) AS a, count(*) FILTER (v36 > 0) AS b, count(*) FILTER (v36 > 0 AND prize > 0.3) AS c, count(DISTINCT CASE WHEN v36 > 0 AND prize > 0.3 THEN location END) AS d FROM stores) SELECT * FROM (SELECT 1 AS step, 'licences' AS stage, a AS n FROM f UNION ALL SELECT 2, 'observed', b FROM f UNION ALL SELECT 3, 'high prize', c FROM f UNION ALL SELECT 4, 'locations', d FROM f)")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stores each stage keeps."""
    seen, high = F.col("v36") > 0, (F.col("v36") > 0) & (F.col("prize") > 0.3)
    one = stores(spark, sf_dir).agg(F.count("*").alias("a"), F.count_if(seen).alias("b"), F.count_if(high).alias("c"), F.countDistinct(F.when(high, F.col("location"))).alias("d"))
    return one.select(F.expr("stack(4, 1, 'licences', a, 2, 'observed', b, 3, 'high prize', c, 4, 'locations', d) AS (step, stage, n)"))


@query("ag20_date_quality", "WITH d AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS dt FROM orders) SELECT o_orderstatus, 'missing' AS kind, count(*) FILTER (dt IS NULL) AS n FROM d GROUP BY 1 UNION ALL SELECT o_orderstatus, 'present', count(*) FILTER (dt IS NOT NULL) FROM d GROUP BY 1")
def date_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without a date."""
    d = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("dt"))
    g = d.groupBy("o_orderstatus").agg(F.count_if(F.col("dt").isNull()).alias("missing"), F.count_if(F.col("dt").isNotNull()).alias("present"))
    return g.unpivot(["o_orderstatus"], ["missing", "present"], "kind", "n")


@query(
    "ag22_entropy_jaccard",
    "WITH s AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS cycle, o_custkey AS store FROM orders), f AS (SELECT store, count(*) AS k FROM s GROUP BY 1), e AS (SELECT -sum(k / t * log2(k / t)) AS entropy, count(*) AS distinct_stores FROM (SELECT k, CAST(sum(k) OVER () AS DOUBLE) AS t FROM f)), n AS (SELECT cycle, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.cycle, count(*) AS shared FROM s a JOIN s b ON b.store = a.store AND b.cycle = a.cycle + 1 GROUP BY 1), j AS (SELECT avg(coalesce(shared, 0) / CAST(a.n + b.n - coalesce(shared, 0) AS DOUBLE)) AS jaccard FROM n a JOIN n b ON b.cycle = a.cycle + 1 LEFT JOIN o ON o.cycle = a.cycle) SELECT round(entropy, 5) AS entropy_bits, distinct_stores, round(jaccard, 6) AS jaccard FROM e, j",
)
def entropy_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unpredictable selections are: entropy of stores, and mean overlap of consecutive cycles."""
    s = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("cycle"), F.col("o_custkey").alias("store")).distinct()
    per = s.groupBy("store").agg(F.count("*").alias("k"))
    total = per.agg(F.sum("k").cast("double").alias("t"))
    share = F.col("k") / F.col("t")
    e = per.join(F.broadcast(total)).agg(F.round(-F.sum(share * F.log2(share)), 5).alias("entropy_bits"), F.count("*").alias("distinct_stores"))
    n = s.groupBy("cycle").agg(F.count("*").alias("n"))
    nxt = s.select((F.col("cycle") - 1).alias("cycle"), "store")
    both = s.join(nxt, ["cycle", "store"]).groupBy("cycle").agg(F.count("*").alias("both"))
    pairs = n.join(n.select((F.col("cycle") - 1).alias("cycle"), F.col("n").alias("m")), "cycle").join(both, "cycle", "left")
    k = F.coalesce("both", F.lit(0))
    return e.join(F.broadcast(pairs.agg(F.round(F.avg(k / (F.col("n") + F.col("m") - k)), 6).alias("jaccard"))))


@query(
    "ag23_policy_metrics",
    f"WITH {STORES}, q AS (SELECT quantile_cont(h, 0.6666666666666666) AS q FROM stores), s AS (SELECT o_orderpriority AS policy, st.* FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders) JOIN stores st ON store = o_custkey) SELECT policy, count(*) AS checks, round(sum(p), 4) AS expected, round(sum(p) / (count(*) * 40 / 60.0::DOUBLE), 6) AS per_hour, round(count(*) * 116 / sum(p), 4) AS cost_per_detected, round(avg(CAST(h >= q AS INTEGER)), 6) AS high_exposure FROM s, q GROUP BY policy",
)
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected violations, per hour and per dollar, and share of high exposure, for each policy's selection (AG23, AG24, NB2)."""
    s = stores(spark, sf_dir)
    ends = s.agg(F.percentile("h", 2 / 3).alias("q"))
    chosen = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("policy"), F.col("o_custkey").alias("store")).distinct().join(s, "store").join(F.broadcast(ends))
    return chosen.groupBy("policy").agg(F.count("*").alias("checks"), F.round(F.sum("p"), 4).alias("expected"), F.round(F.sum("p") / (F.count("*") * 40 / 60.0), 6).alias("per_hour"), F.round(F.try_divide(F.count("*") * 116, F.sum("p")), 4).alias("cost_per_detected"), F.round(F.avg((F.col("h") >= F.col("q")).cast("int")), 6).alias("high_exposure"))


@query(
    "ag25_crosstab_margins",
    f"WITH {CHECKS} SELECT coalesce(CAST(fy AS VARCHAR), 'All') AS fy, coalesce(outcome, 'All') AS outcome, count(*) AS n, count(DISTINCT entity) AS entities FROM checks GROUP BY CUBE (fy, outcome)",
)
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years by outcomes with margins: grouping sets."""
    g = checks(spark, sf_dir).cube("fy", "outcome").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
    return g.select(F.coalesce(F.col("fy").cast("string"), F.lit("All")).alias("fy"), F.coalesce("outcome", F.lit("All")).alias("outcome"), "n", "entities")


@query(
    "ag25_table_audit",
    "SELECT 'c_name' AS col, count(*) AS n, count(*) FILTER (c_name IS NULL) AS nulls, count(DISTINCT c_name) AS uniques, count(*) FILTER (c_name IN ('', 'NA', 'UNKNOWN')) AS placeholders FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment), count(*) FILTER (c_mktsegment IN ('', 'NA', 'UNKNOWN')) FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (c_nationkey IS NULL), count(DISTINCT c_nationkey), 0 FROM customer",
)
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, distinct values and placeholders of each column, from one scan of unpivoted values."""
    c = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return c.unpivot([], c.columns, "col", "v").groupBy("col").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.countDistinct("v").alias("uniques"), F.count_if(F.col("v").isin("", "NA", "UNKNOWN")).alias("placeholders"))


@query(
    "ag26_spearman",
    f"WITH {STORES}, t AS (SELECT tract, avg(p) AS a, avg(prize) AS b FROM stores GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM t) SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over tracts; the windows run over one row per tract."""
    from sparkwarden.functions.stats import average_rank

    t = stores(spark, sf_dir).groupBy("tract").agg(F.avg("p").alias("a"), F.avg("prize").alias("b"))
    r = t.select(average_rank("a").alias("ra"), average_rank("b").alias("rb"))
    return r.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


def best_per(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of each key with the highest score, the least tie breaker among equals: an aggregate, not a sort."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(tie))).alias("b"))
    return best.select("b.*")


@query("wn6_best_per_location", f"WITH {STORES}, r AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY prize DESC, store) AS rn FROM stores) SELECT location, store, segment, round(prize, 6) AS prize FROM r WHERE rn = 1")
def best_per_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store with the highest prize of each location."""
    return best_per(stores(spark, sf_dir), "location", "prize", "store").select("location", "store", "segment", F.round("prize", 6).alias("prize"))


@query("wn7_store_dedupe", f"WITH {STORES}, r AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY prize DESC, store) AS rn, bool_or(v36 > 0) OVER (PARTITION BY location) AS any_observed FROM stores) SELECT location, store, any_observed FROM r WHERE rn = 1")
def store_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best store of each location, and whether any there was observed."""
    best = F.max_by("store", F.struct("prize", -F.col("store"))).alias("store")
    return stores(spark, sf_dir).groupBy("location").agg(best, F.bool_or(F.col("v36") > 0).alias("any_observed"))


_PATH = "path AS (SELECT CAST(year(o_orderdate) AS INTEGER) * 12 + CAST(month(o_orderdate) AS INTEGER) AS step, count(*) AS checks, sum(o_totalprice) AS dollars FROM orders GROUP BY 1)"


@query("wn10_marginal_differences", f"WITH {_PATH}, d AS (SELECT step, checks - lag(checks) OVER w AS d_checks, dollars - lag(dollars) OVER w AS d_dollars FROM path WINDOW w AS (ORDER BY step)) SELECT step, d_checks, round(d_dollars, 2) AS d_dollars, round(d_dollars / nullif(d_checks, 0), 4) AS dollars_per_check FROM d")
def marginal_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences along an ordered path, and their ratio; the path has one row per month."""
    path = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("step")).agg(F.count("*").alias("checks"), F.sum("o_totalprice").alias("dollars"))
    w = Window.orderBy("step")
    d = path.select("step", (F.col("checks") - F.lag("checks").over(w)).alias("d_checks"), (F.col("dollars") - F.lag("dollars").over(w)).alias("dd"))
    return d.select("step", "d_checks", F.round("dd", 2).alias("d_dollars"), F.round(F.try_divide("dd", "d_checks"), 4).alias("dollars_per_check"))


def concentration(df: DataFrame, score: str, value: str, tie: str, *groups: str) -> DataFrame:
    """Cumulative share of value by descending score, and by descending value (the best possible), from the origin on."""
    rows = df.select(*dict.fromkeys([*groups, tie]), F.col(score).alias("_s"), F.greatest(F.col(value), F.lit(0)).cast("double").alias("_v"))
    total = rows.groupBy(*groups).agg(F.sum("_v").alias("_t"))

    def curve(order: str, out: str) -> DataFrame:
        placed = place_within(rows, order, tie, *groups, out="k", total="n")
        # running sums: over runs of places, then within each run
        placed = placed.withColumn("_run", F.expr("(k - 1) div 4096"))
        sums = placed.groupBy(*groups, "_run").agg(F.sum("_v").alias("_r"))
        before = F.coalesce(F.sum("_r").over(Window.partitionBy(*groups).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        within = F.sum("_v").over(Window.partitionBy(*groups, "_run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        run = placed.join(sums.withColumn("_before", before).drop("_r"), [*groups, "_run"]).withColumn("_sum", F.col("_before") + within)
        return run.join(total, list(groups)).select(*groups, "k", (F.col("k") / F.col("n")).alias("share"), F.try_divide("_sum", "_t").alias(out))

    both = curve("_s", "captured").join(curve("_v", "best").drop("share"), [*groups, "k"])
    origin = rows.select(*groups).distinct().select(*groups, F.lit(0).alias("k"), F.lit(0.0).alias("share"), F.lit(0.0).alias("captured"), F.lit(0.0).alias("best"))
    return both.unionByName(origin)


@query(
    "wn11_concentration_curve",
    f"WITH {STORES}, a AS (SELECT tract, row_number() OVER o AS k, row_number() OVER o / CAST(count(*) OVER (PARTITION BY tract) AS DOUBLE) AS share, sum(v36) OVER (PARTITION BY tract ORDER BY prize DESC, store ROWS UNBOUNDED PRECEDING) / CAST(sum(v36) OVER (PARTITION BY tract) AS DOUBLE) AS captured FROM stores WINDOW o AS (PARTITION BY tract ORDER BY prize DESC, store)), b AS (SELECT tract, row_number() OVER (PARTITION BY tract ORDER BY v36 DESC, store) AS k, sum(v36) OVER (PARTITION BY tract ORDER BY v36 DESC, store ROWS UNBOUNDED PRECEDING) / CAST(sum(v36) OVER (PARTITION BY tract) AS DOUBLE) AS best FROM stores) SELECT tract, k, round(share, 6) AS share, round(captured, 6) AS captured, round(best, 6) AS best FROM a JOIN b USING (tract, k) UNION ALL SELECT DISTINCT tract, 0, 0, 0, 0 FROM stores",
)
def concentration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of violations along the prize ranking, per tract."""
    c = concentration(stores(spark, sf_dir), "prize", "v36", "store", "tract")
    return c.select("tract", "k", *[F.round(x, 6).alias(x) for x in ("share", "captured", "best")])


def first_crossing(df: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """Where y first crosses zero along x, by linear interpolation; exact zeros count; null if it never does."""
    w = Window.partitionBy(*groups).orderBy(x)
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    at = F.when(F.col(y) == 0, F.col(x)).when(F.col(y) * ny < 0, F.col(x) - F.col(y) * (nx - F.col(x)) / (ny - F.col(y)))
    return df.select(*groups, at.alias("_at")).groupBy(*groups).agg(F.min("_at").alias("crossing"))


@query(
    "wn12_zero_crossing",
    "WITH m AS (SELECT l_suppkey AS entity, CAST(month(l_shipdate) AS DOUBLE) AS x, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) - 0.34::DOUBLE AS y FROM lineitem GROUP BY ALL), l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM m WINDOW w AS (PARTITION BY entity ORDER BY x)) SELECT entity, round(min(CASE WHEN y = 0 THEN x WHEN y * ny < 0 THEN x - y * (nx - x) / (ny - y) END), 5) AS crossing FROM l GROUP BY entity",
)
def zero_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month where each entity's violation rate first crosses 34 %."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.month("l_shipdate").cast("double").alias("x")).agg((F.avg((F.col("l_returnflag") == "R").cast("double")) - 0.34).alias("y"))
    return first_crossing(m, "x", "y", "entity").select("entity", F.round("crossing", 5).alias("crossing"))


@query("wn13_split_chunks", f"WITH {STORES} SELECT store, ntile(9) OVER (PARTITION BY tract ORDER BY prize DESC, store) AS chunk FROM stores")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered stores of each tract in nine chunks whose sizes differ by one at most."""
    placed = place_within(stores(spark, sf_dir).select("store", "tract", "prize"), "prize", "store", "tract")
    return placed.select("store", ntile(9, F.col("rn"), F.col("n_all")).alias("chunk"))


@query("tk1_global_top", f"WITH {STORES} SELECT store, round(prize, 6) AS prize, round(h * p, 6) AS risk_part, round(prize - h * p, 6) AS deterrence_part FROM stores ORDER BY stores.prize DESC, store LIMIT 100")
def global_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred highest prizes, split into risk and deterrence (TK1, TK7)."""
    top = stores(spark, sf_dir).orderBy(F.desc("prize"), "store").limit(100)
    return top.select("store", F.round("prize", 6).alias("prize"), F.round(F.col("h") * F.col("p"), 6).alias("risk_part"), F.round(F.col("prize") - F.col("h") * F.col("p"), 6).alias("deterrence_part"))


@query("tk3_top_categories", f"WITH {STORES}, t AS (SELECT tract FROM stores GROUP BY tract ORDER BY sum(prize) DESC, tract LIMIT 5) SELECT tract, segment, count(*) AS n, round(sum(prize), 4) AS value FROM stores WHERE tract IN (SELECT tract FROM t) GROUP BY ALL")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the five tracts with the highest total (TK3, TK6)."""
    g = stores(spark, sf_dir).groupBy("tract", "segment").agg(F.count("*").alias("n"), F.sum("prize").alias("value"))
    top = g.groupBy("tract").agg(F.sum("value").alias("v")).orderBy(F.desc("v"), "tract").limit(5).select("tract")
    return g.join(F.broadcast(top), "tract", "left_semi").select("tract", "segment", "n", F.round("value", 4).alias("value"))


@query("tk4_top_by_frequency", "WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8) SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.75) AS q3, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM t) GROUP BY p_brand")
def top_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the eight most frequent brands."""
    part = table(spark, sf_dir, "part")
    top = part.groupBy("p_brand").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "p_brand").limit(8).select("p_brand")
    q = F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = part.join(F.broadcast(top), "p_brand", "left_semi").groupBy("p_brand").agg(q.alias("q"), F.count("*").alias("n"))
    return g.select("p_brand", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "n")


@query("tk5_ranked_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def ranked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a sorted table."""
    return table(spark, sf_dir, "orders").dropna(subset=["o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_totalprice")


def lift_at(df: DataFrame, score: str, y: str, share: float, tie: list[str], *groups: str) -> DataFrame:
    """Hit rate among the top share (one row at least) over the base rate, per group."""
    rows = df.select(*groups, F.col(score).alias("_s"), F.col(y).alias(y), F.struct(*tie).alias("_tie"))
    placed = place_within(rows, "_s", "_tie", *groups)
    top = F.col("rn") <= F.greatest(F.bround(share * F.col("n_all"), 0), F.lit(1))
    g = placed.withColumn("_top", top).groupBy(*groups).agg(F.avg(F.when(F.col("_top"), F.col(y))).alias("hit"), F.avg(y).alias("base"))
    return g.select(*groups, F.try_divide("hit", "base").alias("lift"))


@query(
    "tk8_lift",
    f"WITH {STORES}, r AS (SELECT tract, CAST(v36 >= 4 AS INTEGER) AS y, row_number() OVER (PARTITION BY tract ORDER BY prize DESC, store) <= greatest(round_even(0.1 * count(*) OVER (PARTITION BY tract), 0), 1) AS top FROM stores) SELECT tract, round(avg(CASE WHEN top THEN y END) / nullif(avg(y), 0), 6) AS lift FROM r GROUP BY tract",
)
def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of the top tenth by prize in each tract."""
    s = stores(spark, sf_dir).withColumn("y", (F.col("v36") >= 4).cast("int"))
    return lift_at(s, "prize", "y", 0.1, ["store"], "tract").select("tract", F.round("lift", 6).alias("lift"))


@query(
    "tk9_lambda_robustness",
    f"WITH {STORES}, g AS (SELECT l, store, tract, p, h, row_number() OVER (PARTITION BY l ORDER BY h * p + l * det DESC, store) AS rn FROM stores, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) t(l)), t AS (SELECT * FROM g WHERE rn <= 44) SELECT l AS lambda, count(*) AS n, count(b.store) AS overlap, count(DISTINCT t.tract) AS tracts, round(avg(t.p), 6) AS mean_p, round(avg(t.h), 6) AS mean_h FROM t LEFT JOIN (SELECT store FROM t WHERE l = 0.25) b USING (store) GROUP BY l",
)
def lambda_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 44 under other weights of deterrence, and what they share with the usual one (TK9, NB1).

    Each weight's selection is a top-k of its own, so no window sorts all stores in one task.
    """
    s = stores(spark, sf_dir)
    tops = [s.select(F.lit(v).alias("lambda"), "store", "tract", "p", "h", (F.col("h") * F.col("p") + v * F.col("det")).alias("r")).orderBy(F.desc("r"), "store").limit(44) for v in (0.0, LAMBDA, 0.5)]
    t = tops[0].unionByName(tops[1]).unionByName(tops[2])
    base = t.where(F.col("lambda") == LAMBDA).select("store", F.lit(1).alias("b"))
    return t.join(F.broadcast(base), "store", "left").groupBy("lambda").agg(F.count("*").alias("n"), F.count("b").alias("overlap"), F.countDistinct("tract").alias("tracts"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("h"), 6).alias("mean_h"))


@query("tk10_strongest_row", "WITH g AS (SELECT l_returnflag AS delta, l_linestatus AS rho, l_shipmode AS policy, found FROM (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_shipmode, avg(l_discount) AS found FROM lineitem GROUP BY ALL)), w AS (SELECT delta, rho FROM g WHERE policy = '1' ORDER BY found, delta, rho LIMIT 1) SELECT g.delta, g.rho, g.policy, round(g.found, 6) AS found FROM g JOIN w USING (delta, rho)")
def strongest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the cell where one policy does worst (TK10)."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("delta"), F.col("l_linestatus").alias("rho"), F.col("l_linenumber").cast("string").alias("policy")).agg(F.avg("l_discount").alias("found"))
    worst = g.where("policy = '1'").agg(F.min_by(F.struct("delta", "rho"), F.struct("found", "delta", "rho")).alias("w")).select("w.*")
    return g.join(F.broadcast(worst), ["delta", "rho"]).select("delta", "rho", "policy", F.round("found", 6).alias("found"))


@query("so1_union", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL::DOUBLE AS qty FROM orders UNION ALL SELECT 'item', l_orderkey, NULL, l_quantity FROM lineitem WHERE l_linenumber = 1")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources with different columns."""
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.lit("item").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("qty"))
    return a.unionByName(b, allowMissingColumns=True)


@query("so2_intersection", "SELECT o_custkey AS store FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores in both selections."""
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("store")).intersect(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("store")))


@query("so3_difference", "SELECT c_custkey AS store FROM customer EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible stores: all but those done."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store")).exceptAll(table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("store")).distinct())


@query("so5_pivot", "SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heatmap's cells (SO5, NB3)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).sum("l_quantity")


@query("so7_explode_names", "SELECT p_type, word, count(*) AS n FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL")
def explode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited lists as rows."""
    return table(spark, sf_dir, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("word")).groupBy("p_type", "word").agg(F.count("*").alias("n"))


@query("nb4_describe", f"WITH {STORES} SELECT segment, count(p) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, round(min(p), 6) AS least, round(quantile_cont(p, 0.25), 6) AS q1, round(quantile_cont(p, 0.5), 6) AS q2, round(quantile_cont(p, 0.75), 6) AS q3, round(max(p), 6) AS most FROM stores GROUP BY segment")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary statistics of a column by group."""
    q = F.percentile("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = stores(spark, sf_dir).groupBy("segment").agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"), F.min("p").alias("least"), q.alias("q"), F.max("p").alias("most"))
    return g.select("segment", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "least")], *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], F.round("most", 6).alias("most"))
