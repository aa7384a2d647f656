"""The tables, and the views of them that the queries work on, each also as a SQL common table expression.

The driver's tables stand for inspection data: line items are checks of entities (suppliers) on days, customers are
licensed stores of which three share a location, nations are tracts, and embeddings give points in the plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.rng import uniform, uniform_sql

#: Weights of penalty depths 0 to 4, points of outcomes, and the weight of deterrence in a prize.
DEPTH_WEIGHTS = (0.25, 0.6, 0.8, 1.0, 1.0)
POINTS = {"WL": 1.0, "CMP": 2.0, "NTSO": 4.0}
LAMBDA = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per check: entity, day, dn (days since 1970), y (violation), up (undercover), fy, outcome, points, keys."""
    item = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    outcome = F.when(F.col("l_linenumber") == 6, "CMP").when(F.col("l_linenumber") == 7, "NTSO").when(F.col("l_returnflag") == "R", "WL").otherwise("NONE")
    return item.select(
        F.col("l_suppkey").alias("entity"),
        day.alias("day"),
        F.unix_date(day).alias("dn"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_linestatus") == "F").alias("up"),
        (F.year(day) + (F.month(day) >= 10).cast("int")).alias("fy"),
        outcome.alias("outcome"),
        F.col("l_partkey").alias("part"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("qty"),
    )


CHECKS = """checks AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS dn,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus = 'F' AS up,
 CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fy,
 CASE WHEN l_linenumber = 6 THEN 'CMP' WHEN l_linenumber = 7 THEN 'NTSO' WHEN l_returnflag = 'R' THEN 'WL' ELSE 'NONE' END AS outcome,
 l_partkey AS part, l_orderkey AS orderkey, l_linenumber AS line, l_quantity AS qty FROM lineitem)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per licensed store: store, location, tract, segment, name, p, h, v36, days_since, det, prize."""
    c = table(spark, sf_dir, "customer")
    base = c.select(
        F.col("c_custkey").alias("store"),
        F.expr("c_custkey div 3").alias("location"),
        F.col("c_nationkey").alias("tract"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("name"),
        (0.02 + 0.6 * (F.col("c_acctbal") + 1000) / 11000).alias("p"),
        uniform("h", "c_custkey").alias("h"),
        F.floor(uniform("v", "c_custkey") * 6).cast("int").alias("v36"),
        F.floor(uniform("d", "c_custkey") * 1826).cast("int").alias("days_since"),
    )
    weights = F.array(*[F.lit(w) for w in DEPTH_WEIGHTS])
    det = F.element_at(weights, F.least("v36", F.lit(4)) + 1) * F.least(F.col("days_since") / 365.0, F.lit(1.0))
    return base.withColumn("det", det).withColumn("prize", F.col("h") * F.col("p") + LAMBDA * F.col("det"))


STORES = f"""base_stores AS (SELECT c_custkey AS store, c_custkey // 3 AS location, c_nationkey AS tract, c_mktsegment AS segment, c_name AS name,
 0.02 + 0.6 * (c_acctbal + 1000) / 11000 AS p, {uniform_sql("h", "c_custkey")} AS h, CAST(floor({uniform_sql("v", "c_custkey")} * 6) AS INTEGER) AS v36,
 CAST(floor({uniform_sql("d", "c_custkey")} * 1826) AS INTEGER) AS days_since FROM customer),
 det_stores AS (SELECT *, CASE least(v36, 4) WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * least(days_since / 365.0::DOUBLE, 1.0::DOUBLE) AS det FROM base_stores),
 stores AS (SELECT *, h * p + 0.25 * det AS prize FROM det_stores)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per point of the plane, in metres: id, label, x, y."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.element_at("embedding", k).cast("double") * 1000
    return e.select(F.col("vec_id").alias("id"), "label", at(1).alias("x"), at(2).alias("y"))


POINTS_SQL = "points AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings)"


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per licence, with a raw name, street and zip as a source would write them."""
    c = table(spark, sf_dir, "customer")
    street = F.concat(
        (F.col("c_custkey") % 997).cast("string"),
        F.element_at(F.array(*map(F.lit, (" North ", "  south ", " East. ", " "))), (F.col("c_nationkey") % 4 + 1).cast("int")),
        F.initcap("c_mktsegment"),
        F.element_at(F.array(*map(F.lit, (" Street", " Avenue, Apt 2", " Blvd.", " Fifth Road #7", " Lane Suite 3"))), (F.col("c_custkey") % 5 + 1).cast("int")),
    )
    zip_code = F.concat(F.lpad((F.col("c_nationkey") * 731).cast("string"), 5, "0"), F.lit("-1234"))
    name = F.concat(F.lit("  The "), F.lower("c_mktsegment"), F.element_at(F.array(*map(F.lit, (" Smoke Shop", " Dollar Mart", " Pharmacy", " Corner Market", " Pizza", " Fuel #", " Holdings LLC"))), (F.col("c_custkey") % 7 + 1).cast("int")), (F.col("c_custkey") % 10).cast("string"))
    return c.select(F.col("c_custkey").alias("licence"), name.alias("name"), street.alias("street"), zip_code.alias("zip"), F.col("c_nationkey").alias("tract"), "c_acctbal")


LICENCES = """licences AS (SELECT c_custkey AS licence,
 '  The ' || lower(c_mktsegment) || ([' Smoke Shop', ' Dollar Mart', ' Pharmacy', ' Corner Market', ' Pizza', ' Fuel #', ' Holdings LLC'])[CAST(c_custkey % 7 + 1 AS INTEGER)] || CAST(c_custkey % 10 AS VARCHAR) AS name,
 CAST(c_custkey % 997 AS VARCHAR) || ([' North ', '  south ', ' East. ', ' '])[CAST(c_nationkey % 4 + 1 AS INTEGER)] || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ([' Street', ' Avenue, Apt 2', ' Blvd.', ' Fifth Road #7', ' Lane Suite 3'])[CAST(c_custkey % 5 + 1 AS INTEGER)] AS street,
 lpad(CAST(c_nationkey * 731 AS VARCHAR), 5, '0') || '-1234' AS zip, c_nationkey AS tract, c_acctbal FROM customer)"""
