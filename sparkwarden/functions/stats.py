"""Statistics as column and window expressions, with the conventions that the queries rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.sources.shared import settled


def half_even(c: Column, digits: int) -> Column:
    """Rounding half to even."""
    return F.bround(c, digits)


def average_rank(order: str, *groups: str) -> Column:
    """Rank where ties share the mean of their places."""
    w = Window.partitionBy(*groups)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*groups, order)) - 1) / 2


#: Buckets of a score's range that ``place_within`` sorts one by one.
BUCKETS = 4096


def place_within(df: DataFrame, score: str, tie: str, *groups: str, out: str = "rn", total: str = "n_all", ends: tuple[float, float] | None = None) -> DataFrame:
    """df with the place of each row by falling score (ties by rising ``tie``, nulls last) in its group, and the group's size.

    A score's range is cut into ``BUCKETS`` buckets.  Rows are sorted within (group, bucket) alone, and the places before a
    bucket come from counts, so a group with a third of all rows is spread over thousands of tasks.  ``ends``: least and
    largest score, where they are known.
    """
    if ends is None:
        base = df.join(F.broadcast(df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))))  # one row
    else:
        base = df.withColumns({"_lo": F.lit(ends[0]), "_hi": F.lit(ends[1])})
    wide = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    bucket = F.coalesce(F.least(F.floor((F.col("_hi") - F.col(score)) / wide * BUCKETS), F.lit(BUCKETS - 1)), F.lit(BUCKETS)).cast("int")
    rows = base.withColumn("_b", bucket).drop("_lo", "_hi")
    sizes = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups)  # at most BUCKETS + 1 rows of a group
    before = F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_b").alias("_ob"), before.alias("_before"), F.sum("_n").over(w).alias(total))
    same = F.col("_b") == F.col("_ob")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    own = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(F.desc(score), tie))
    placed = rows.withColumn("_own", own).join(offsets, same)
    return placed.withColumn(out, F.col("_own") + F.col("_before")).select(*df.columns, out, total)


def lowest_within(df: DataFrame, score: str, tie: str, k: str, *groups: str, buckets: int = 256, most: int = 500_000, highest: bool = False) -> DataFrame:
    """The rows of each group with the ``k`` lowest scores (from 0 to below 1; k is a column, one value in a group), ties by rising ``tie``.

    ``highest``: those with the highest scores, nulls last.

    Counts per bucket of scores tell in which bucket a group's k-th row lies; rows of lower buckets are in, and only
    that bucket's rows are sorted.  df is read twice and not shuffled, where the groups are at most ``most``.
    """
    near = F.coalesce(F.least(F.floor((1 - F.col(score)) * buckets), F.lit(buckets - 1)), F.lit(buckets)) if highest else F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1))
    rows = df.withColumn("_b", near.cast("int"))
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_n"), F.max(k).alias("_k"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = counts.withColumn("_before", before).where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k")))
    marks = settled(marks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_last"), (F.col("_k") - F.col("_before")).alias("_left")))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    marked = rows.where(F.col(k) > 0).join(F.broadcast(marks) if marks.count() <= most else marks, same, "left")
    sure = marked.where(F.col("_last").isNull() | (F.col("_b") < F.col("_last"))).select(*df.columns)
    edge = marked.where(F.col("_b") == F.col("_last")).withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score) if highest else score, tie)))
    return sure.unionByName(edge.where(F.col("_rn") <= F.col("_left")).select(*df.columns))


def quantile_bucket(q: int, place: Column, n: Column) -> Column:
    """Bucket 0..q-1 of a row by its place among n, with the edges of linear quantiles of the places."""
    return F.greatest(F.ceil((place - 1) * q / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


def ntile(q: int, place: Column, n: Column) -> Column:
    """Chunk 1..q of a row by its place among n; sizes differ by one at most, larger ones first."""
    small, more = F.floor(n / q), n % q
    return F.when(place <= more * (small + 1), F.floor((place - 1) / (small + 1)) + 1).otherwise(F.floor((place - 1 - more) / F.greatest(small, F.lit(1))) + 1).cast("int")


def auc(df: DataFrame, score: str, label: str, *groups: str) -> DataFrame:
    """Area under the curve per group, by rank sums of score values.

    Rows are first counted per value, so the windows run over distinct values alone.
    """
    at = df.groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    w = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = at.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*groups).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    n0 = F.col("n") - F.col("n1")
    return sums.select(*groups, F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * n0).alias("auc"))
