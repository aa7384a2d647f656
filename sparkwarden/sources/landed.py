"""Readers of landed files as sources write them: CSV with points in text, a file per year, preambles, nested JSON, caches.

The queries first land files that Spark derives from the tables in the folder that all executors share, then read them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.text import location_key, zip5
from sparkwarden.plans.registry import query
from sparkwarden.sources.shared import shared_path
from sparkwarden.sources.tables import CHECKS, LICENCES, POINTS_SQL, checks, licences, points, table

_ADDR = "trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(street)), '\\s+', ' ', 'g'), '[.,]', '', 'g'), '\\s+', ' ', 'g')) || '|' || nullif(regexp_extract(zip, '([0-9]{5})', 1), '')"


def landing(spark: SparkSession) -> str:
    """A new folder for landed files, shared by all executors."""
    return shared_path(spark, "landed")


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """Licence CSV: coordinates from POINT text, keys, hashed ids, retail flag and expiry (SRC2, SRC7)."""
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"')
    at = lambda k: F.try_to_number(F.nullif(F.regexp_extract("georeference", r"POINT \((-?[\d.]+) (-?[\d.]+)\)", k), F.lit("")), F.lit("S99990.999999")).cast("double")
    key = location_key(F.col("street_address"), F.col("postal_code"))
    return raw.select(
        F.col("account").cast("bigint").alias("account"), F.substring(F.md5(F.concat_ws("|", "account", "license_type", key)), 1, 10).alias("license_id"), key.alias("location_key"), zip5(F.col("postal_code")).alias("zip5"),
        F.col("license_type").rlike("(?i)retail").alias("retail"), F.expr("try_cast(expiration_date AS date)").alias("expires"), at(1).alias("lon"), at(2).alias("lat"),
    )


@query(
    "src7_license_csv",
    f"WITH {LICENCES}, r AS (SELECT licence, {_ADDR} AS k, nullif(regexp_extract(zip, '([0-9]{{5}})', 1), '') AS zip5, CASE WHEN licence % 3 = 0 THEN 'Wholesale' ELSE 'Retail Shop' END AS t FROM licences) SELECT licence AS account, substr(md5(concat_ws('|', CAST(licence AS VARCHAR), t, k)), 1, 10) AS license_id, k AS location_key, zip5, t = 'Retail Shop' AS retail, CASE WHEN licence % 5 = 0 THEN NULL ELSE DATE '2027-01-01' + CAST(licence % 300 AS INTEGER) END AS expires, CASE WHEN licence % 4 = 0 THEN NULL ELSE -80 + licence % 100 / 1000.0::DOUBLE END AS lon, CASE WHEN licence % 4 = 0 THEN NULL ELSE 40 + licence % 77 / 1000.0::DOUBLE END AS lat FROM r",
)
def license_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences landed as CSV and parsed."""
    path, c = landing(spark), F.col("licence")
    point = F.when(c % 4 != 0, F.concat(F.lit("POINT ("), F.format_string("%.3f", -80 + c % 100 / 1000.0), F.lit(" "), F.format_string("%.3f", 40 + c % 77 / 1000.0), F.lit(")")))
    expires = F.when(c % 5 != 0, F.date_add(F.lit("2027-01-01").cast("date"), (c % 300).cast("int")).cast("string")).otherwise("none")
    raw = licences(spark, sf_dir).select(c.alias("account"), F.when(c % 3 == 0, "Wholesale").otherwise("Retail Shop").alias("license_type"), F.col("street").alias("street_address"), F.col("zip").alias("postal_code"), expires.alias("expiration_date"), point.alias("georeference"))
    raw.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_licences(spark, path)


@query("src8_multi_file_scan", f"WITH {CHECKS} SELECT fy, count(*) AS records, CAST(sum(y) AS BIGINT) AS violations FROM checks WHERE outcome <> 'NONE' GROUP BY fy")
def multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed CSV files by year; the year comes from the file's path, the filter from the rows (SRC8, SRC9)."""
    path = landing(spark)
    checks(spark, sf_dir).select("entity", "y", "outcome", F.concat(F.lit("FY"), F.col("fy")).alias("file")).write.partitionBy("file").option("compression", "gzip").csv(path, header=True)
    rows = spark.read.option("recursiveFileLookup", "true").csv(path, schema="entity bigint, y int, outcome string", header=True).where("outcome <> 'NONE'")
    return rows.select("y", F.regexp_extract("_metadata.file_path", r"FY(\d{4})", 1).cast("int").alias("fy")).groupBy("fy").agg(F.count("*").alias("records"), F.sum("y").alias("violations"))


@query("src10_preamble_csv", "SELECT p_partkey AS part, p_brand AS brand, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM part WHERE p_type = 'ECONOMY'")
def preamble_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with lines of text before the header: data lines are told by their form and parsed (SRC10)."""
    path = landing(spark)
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", "p_type", F.when(F.col("p_size") > 25, "Yes").otherwise("No"))
    part = table(spark, sf_dir, "part")
    notes = part.limit(7).select(F.concat(F.lit("Note "), F.col("p_partkey").cast("string")).alias("value"))
    notes.union(part.select(line)).write.text(path)
    data = spark.read.text(path).where(F.col("value").rlike(r"^\d+,"))
    own = data.select(F.from_csv("value", "part bigint, brand string, kind string, large string").alias("r")).select("r.*")
    return own.where("kind = 'ECONOMY'").select("part", "brand", (F.col("large") == "Yes").cast("int").alias("large"))


def first_readable(spark: SparkSession, paths: list[str], columns: str) -> DataFrame:
    """The first of some text sources that is there and has data lines; the others stand by (SRC10).

    A path that does not exist counts as absent; any other failure is one.
    """
    for path in paths:
        try:
            data = spark.read.text(path).where(F.col("value").rlike(r"^\d+,"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if not data.isEmpty():
            return data.select(F.from_csv("value", columns).alias("r")).select("r.*")
    raise FileNotFoundError(f"none of {paths} has data lines")


@query("src10_fallback_source", "SELECT p_brand AS brand, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is missing, one without data lines, and the one that serves (SRC10)."""
    paths = [landing(spark) for _ in range(3)]
    part = table(spark, sf_dir, "part")
    part.limit(3).select(F.concat(F.lit("service is down "), F.col("p_partkey").cast("string")).alias("value")).write.text(paths[1])
    part.select(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string")).alias("value")).write.text(paths[2])
    rows = first_readable(spark, paths, "part bigint, brand string, size int")
    return rows.groupBy("brand").agg(F.count("*").alias("parts"), F.sum("size").alias("size"))


def write_through(keys: DataFrame, cache: str, fetch) -> DataFrame:
    """Rows of all keys from a cache in Parquet; those that it lacks are fetched and appended to it first (SRC12).

    ``keys``: a column key, unique.  ``fetch``: from keys to rows (key, ...).  The cache is read again after
    the append, so a second call fetches nothing.
    """
    spark = keys.sparkSession
    misses = keys.join(spark.read.parquet(cache).select("key"), "key", "left_anti")
    fetch(misses).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(keys, "key", "left_semi")


@query("src12_write_through", "SELECT o_custkey AS key, min(c_nationkey) AS tract, min(CASE WHEN c_custkey % 3 = 0 THEN 'cache' ELSE 'service' END) AS origin FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def cached_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all customers with orders: a third comes from the cache, the rest is fetched and cached (SRC12)."""
    cache = landing(spark)
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("tract"))
    known.where("key % 3 = 0").withColumn("origin", F.lit("cache")).write.parquet(cache)
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return write_through(keys, cache, lambda misses: known.join(misses, "key").withColumn("origin", F.lit("service")))


@query("src12_cache_misses", "SELECT DISTINCT o_custkey AS store FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a cache has not yet: distinct, then an anti join (SRC11, SRC12)."""
    cache = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("store"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store")).distinct().join(cache, "store", "left_anti")


@query("src13_points_of_interest", f"WITH {POINTS_SQL} SELECT id, CASE WHEN label IN (1, 2) THEN 'amenity:' || label WHEN label IN (3, 4) THEN 'leisure:' || label ELSE 'other' END AS site_type, CASE WHEN label % 2 = 0 THEN 'public' ELSE 'private' END AS sector FROM points")
def points_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from two sources under one schema, with types from sparse columns (SRC4, SRC13, SRC14)."""
    p = points(spark, sf_dir)
    public, private = (p.where(f"label % 2 = {k}").withColumn("sector", F.lit(s)) for k, s in ((0, "public"), (1, "private")))
    amenity = F.when(F.col("label").isin(1, 2), F.concat(F.lit("amenity:"), F.col("label").cast("string")))
    leisure = F.when(F.col("label").isin(3, 4), F.concat(F.lit("leisure:"), F.col("label").cast("string")))
    return public.unionByName(private).select("id", F.coalesce(amenity, leisure, F.lit("other")).alias("site_type"), "sector")


@query("src5_nested_json", "SELECT user_id, event_type AS code, CAST(sum(CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS estimate FROM events GROUP BY ALL")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents data[user][code] as nested JSON, landed, parsed and exploded (SRC5)."""
    path = landing(spark)
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
    docs = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "k"))).alias("estimate"))
    docs.select(F.to_json(F.struct(F.col("user_id").alias("geo"), F.struct("estimate").alias("table"))).alias("value")).write.text(path)
    parsed = spark.read.text(path).select(F.from_json("value", "geo bigint, table struct<estimate: map<string, bigint>>").alias("d"))
    return parsed.select(F.col("d.geo").alias("user_id"), F.explode("d.table.estimate").alias("code", "estimate"))


@query("src16_optional_tables", "SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS rows, 6 AS columns UNION ALL SELECT 'events', (SELECT count(*) FROM events), 6 UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), 5 UNION ALL SELECT 'polygons', NULL, 0")
def optional_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which inputs are there, with their columns; those that lack are no error (SRC16, SRC17)."""
    found = []
    for name in ("orders", "events", "documents", "polygons"):
        try:
            df = table(spark, sf_dir, name)
            found.append(df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found.append(spark.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("bigint").alias("rows"), F.lit(0).alias("columns")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
