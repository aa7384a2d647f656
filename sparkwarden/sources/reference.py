"""Reference rates: a fixed table by outlet type and region, and bands by year from an independent sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.text import classify_outlet, classify_outlet_sql
from sparkwarden.plans.registry import query
from sparkwarden.sources.tables import CHECKS, LICENCES, checks, licences

# Visits, violations, and rate with its limits in per cent where 40 or more were visited.
OUTLETS = (
    ("beer_distributor", 95, 9, 8.3, 2.6, 14.0),
    ("convenience_gas", 426, 60, 13.9, 10.4, 17.4),
    ("convenience_independent", 278, 65, 23.7, 18.0, 29.3),
    ("dollar_store", 153, 4, 2.9, 0.0, 6.2),
    ("pharmacy", 14, 0, None, None, None),
    ("bar_tavern", 6, 1, None, None, None),
)
# Selected, completed and violating outlets by region; the first row must be the sum of the others.
REGIONS = (
    ("State", 1698, 1261, 189), ("NC", 103, 85, 5), ("NE", 207, 171, 19), ("NW", 104, 82, 4), ("SC", 170, 145, 6), ("SE", 303, 213, 43), ("SW", 205, 147, 17),
    ("AL", 130, 100, 26), ("DE", 110, 83, 20), ("ER", 100, 65, 8), ("PH", 266, 170, 41),
)


def outlet_rates(spark: SparkSession) -> DataFrame:
    """Rates by outlet type as shares; null where too few were visited."""
    rows = spark.createDataFrame(list(OUTLETS), "outlet_type string, visited int, violations int, rate double, lower double, upper double")
    return rows.select("outlet_type", "visited", "violations", *[(F.col(c) / 100).alias(c) for c in ("rate", "lower", "upper")])


def check_totals() -> None:
    """The regions must add up to the state."""
    for k in (1, 2, 3):
        if sum(r[k] for r in REGIONS[1:]) != REGIONS[0][k]:
            raise ValueError(f"column {k} of the regions doesn't add up")


_RATES = "rates(outlet_type, rate) AS (VALUES " + ", ".join(f"('{o[0]}', {'NULL' if o[3] is None else o[3]}::DOUBLE / 100)" for o in OUTLETS) + ")"


@query("er4_outlet_reference", f"WITH {LICENCES}, {_RATES}, c AS (SELECT {classify_outlet_sql('name')} AS outlet_type, count(*) AS n FROM licences GROUP BY 1) SELECT outlet_type, n, round(rate, 6) AS rate, round(n * rate, 4) AS expected FROM c LEFT JOIN rates USING (outlet_type)")
def outlet_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences by outlet type with the reference rate, and the violations that it would give (ER2 to ER4)."""
    check_totals()
    c = licences(spark, sf_dir).groupBy(classify_outlet(F.col("name")).alias("outlet_type")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(outlet_rates(spark)), "outlet_type", "left").select("outlet_type", "n", F.round("rate", 6).alias("rate"), F.round(F.col("n") * F.col("rate"), 4).alias("expected"))


@query(
    "cv12_reference_band",
    f"WITH {CHECKS}, t AS (SELECT fy, count(*) AS up_checks, avg(y) AS rate FROM checks WHERE up GROUP BY fy), b AS (SELECT fy, avg(y) AS mid, 1.96::DOUBLE * sqrt(avg(y) * (1 - avg(y)) / count(*)) AS half FROM checks WHERE NOT up GROUP BY fy) SELECT fy, up_checks, round(rate, 6) AS rate, round(rate / nullif(mid, 0), 6) AS ratio, rate > mid + half AS above, rate < mid - half AS below FROM t JOIN b USING (fy)",
)
def reference_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly rates of undercover checks against the band of an independent sample (CV12)."""
    log = checks(spark, sf_dir)
    t = log.where("up").groupBy("fy").agg(F.count("*").alias("up_checks"), F.avg("y").alias("rate"))
    b = log.where("NOT up").groupBy("fy").agg(F.avg("y").alias("mid"), (1.96 * F.sqrt(F.avg("y") * (1 - F.avg("y")) / F.count("*"))).alias("half"))
    rate, mid, half = F.col("rate"), F.col("mid"), F.col("half")
    return t.join(b, "fy").select("fy", "up_checks", F.round(rate, 6).alias("rate"), F.round(F.try_divide(rate, mid), 6).alias("ratio"), (rate > mid + half).alias("above"), (rate < mid - half).alias("below"))
