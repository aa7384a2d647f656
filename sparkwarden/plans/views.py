"""The library from ``spark.sql``: a temporary view per table and dataset, and table functions for the figures.

``register_views`` gives every table of the data folder and every dataset of the chart specs as a view.  ``register_figures`` adds
``figure_info(pattern)``, a Python table function over the registry (it carries the registry's few rows and reads nothing), and
``figure_rows(name)``, a SQL table function over the figures' own tables: its condition is on a literal per figure, so Spark drops
the other figures from the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.plans.chartspec import DATASETS, FIGURES, available, figure_table
from sparkwarden.plans.registry import ORACLES, query
from sparkwarden.sources.tables import STORES, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def register_views(spark: SparkSession, sf_dir: str, datasets: Sequence[str] | None = None) -> list[str]:
    """Views of all tables and of the datasets that are available (or of those named); their names.

    A dataset is named ``dataset_<name>``.  An unknown dataset is a KeyError.
    """
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    names = list(datasets) if datasets is not None else list(available(spark, sf_dir))
    for name in names:
        DATASETS[name].make(spark, sf_dir).createOrReplaceTempView(f"dataset_{name}")
    return [*TABLES, *(f"dataset_{n}" for n in names)]


def register_figures(spark: SparkSession, sf_dir: str, figures: Sequence[str] | None = None) -> None:
    """The table functions ``figure_info(pattern)`` and ``figure_rows(name)``, the latter over all figures or those named."""
    known = tuple((name, title, source) for name, (title, source) in FIGURES.items())

    class Info:
        """(figure, title, query) of the figures whose name has the pattern in it."""

        def eval(self, pattern: str):
            for row in known:
                if pattern is not None and pattern in row[0]:
                    yield row

    spark.udtf.register("figure_info", F.udtf(Info, returnType="figure string, title string, query string"))
    rows = None
    for name in figures if figures is not None else FIGURES:
        one = figure_table(name, spark, sf_dir)
        one = one.select(F.lit(name).alias("figure"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(one.columns)))).alias("row"))
        rows = one if rows is None else rows.unionByName(one)
    rows.createOrReplaceTempView("figure_tables")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION figure_rows(name STRING) RETURNS TABLE (figure STRING, row STRING) RETURN SELECT t.figure, t.row FROM figure_tables t WHERE t.figure = figure_rows.name")


#: A dataset's columns through SQL, and what they must equal.
_BY_SEGMENT = "SELECT segment, count(*) AS stores, round(avg(p), 6) AS mean_p, count(DISTINCT o_custkey) AS ordering FROM {stores} LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = store GROUP BY segment"
_SHOWN = ("lift", "calibration", "power")


@query("sql_dataset_view", f"WITH {STORES} {_BY_SEGMENT.format(stores='stores')}")
def dataset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset and a table joined through ``spark.sql`` alone."""
    register_views(spark, sf_dir, ["stores"])
    return spark.sql(_BY_SEGMENT.format(stores="dataset_stores"))


@query("sql_figure_rows", " UNION ALL ".join(f"SELECT '{n}' AS figure, '{FIGURES[n][0]}' AS title, (SELECT count(*) FROM ({ORACLES[FIGURES[n][1]]})) AS rows" for n in _SHOWN))
def figure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures through the table functions: titles from one, rows from the other (CS10, CS11)."""
    register_figures(spark, sf_dir, _SHOWN)
    counts = " UNION ALL ".join(f"SELECT '{n}' AS figure, count(*) AS rows FROM figure_rows('{n}')" for n in _SHOWN)
    return spark.sql(f"SELECT i.figure, i.title, c.rows FROM figure_info('') i JOIN ({counts}) c ON c.figure = i.figure")
