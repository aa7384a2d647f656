"""The event log as a stream: windows with watermarks, sessions, and histories kept in the state of aggregations.

Each query reads the events table as a file stream, runs all that is there (``availableNow``), and returns the sink's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.plans.registry import query
from sparkwarden.sources.shared import shared_path


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; it may be one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parq*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote, from the folder that all executors share."""
    spark = df.sparkSession
    path = shared_path(spark, "stream")
    state = f"{path}-state"
    if mode == "append":
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.where(F.col("batch") == last).drop("batch")


@query("st1_tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums per six hours and type, late data up to a day (complete mode, so that open windows count)."""
    g = stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drained(g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")), "complete")


@query("st2_sliding_windows", "WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) - to_hours(12 * 0) - CASE WHEN k = 1 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS window_start, count(*) AS n FROM e GROUP BY 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per day, a new window every twelve hours."""
    g = stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return drained(g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n"), "complete")


@query("st3_stream_table_join", "SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error'")
def stream_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the stream joined with a table, appended as they come."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return drained(stream(spark, sf_dir).where("event_type = 'error'").join(c, "user_id").select("event_id", "user_id", "c_mktsegment"))


@query("st4_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sightings of each user and type."""
    return drained(stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("st5_stateful_history", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS v FROM events GROUP BY 1")
def stateful_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts per user, kept by the stream's own aggregation state."""
    g = stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("v"))
    return drained(g, "complete")


@query("st6_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after four quiet hours, late data up to a day."""
    g = stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count("*").alias("n"))
    return drained(g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n"), "complete")
