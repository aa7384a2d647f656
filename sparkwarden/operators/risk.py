"""Risk model: features, fit with a penalty chosen on the last year, scores, evaluation and replay over years."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.stats import auc
from sparkwarden.operators.history import HISTORY, training_frame, with_history
from sparkwarden.operators.policy import find_shift, shifted
from sparkwarden.operators.relational import lift_at
from sparkwarden.plans.registry import query
from sparkwarden.sources.shared import settled
from sparkwarden.sources.tables import CHECKS, STORES, checks, stores

NUMERIC = ("log_checks", "prior_share", "viol_12m", "viol_24m", "viol_36m", "days_since_check", "days_since_viol", "log_chain", "prior_fy_rate")
PENALTIES = (0.01, 0.1, 1.0)


class RiskModel:
    """A fitted pipeline with the means and population deviations of its numeric features."""

    def __init__(self, scale: dict[str, tuple[float, float]], model, c: float):
        self.scale, self.model, self.c = scale, model, c

    def predict(self, frame: DataFrame, out: str = "p") -> DataFrame:
        """frame with the probability of a violation."""
        scored = self.model.transform(scaled(frame, self.scale))
        return scored.withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features", *(f"z_{c}" for c in NUMERIC), "outlet_i", "outlet_v")

    def coefficients(self) -> dict[str, float]:
        """Coefficients of the numeric features, the strongest first."""
        own = dict(zip(NUMERIC, self.model.stages[-1].coefficients.toArray(), strict=False))
        return dict(sorted(own.items(), key=lambda kv: -abs(kv[1])))


def scaled(frame: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Numeric features less their mean, over their population deviation."""
    return frame.withColumns({f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, (m, s) in scale.items()})


def fit_with(frame: DataFrame, c: float) -> RiskModel:
    """Logistic regression with an L2 penalty of strength 1 / (c n); unknown outlet types count as none."""
    row = frame.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in NUMERIC], *[F.stddev_pop(x).alias(f"s_{x}") for x in NUMERIC]).first()
    scale = {x: (float(row[f"m_{x}"] or 0), float(row[f"s_{x}"] or 0) or 1.0) for x in NUMERIC}
    stages = [
        StringIndexer(inputCol="outlet", outputCol="outlet_i", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="outlet_i", outputCol="outlet_v", dropLast=True),
        VectorAssembler(inputCols=[*(f"z_{x}" for x in NUMERIC), "outlet_v"], outputCol="features"),
        LogisticRegression(labelCol="y", elasticNetParam=0.0, standardization=False, regParam=1 / (c * max(row["n"], 1)), maxIter=100, tol=1e-9),
    ]
    return RiskModel(scale, Pipeline(stages=stages).fit(scaled(frame, scale)), c)


def log_loss(p: str, y: str):
    """Mean log loss, probabilities clipped."""
    inside = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-(F.col(y) * F.log(inside) + (1 - F.col(y)) * F.log(1 - inside)))


def fit(frame: DataFrame) -> RiskModel:
    """The penalty with the least loss on the last year, refitted on all; with one year alone a fixed one."""
    years = frame.agg(F.min("fy").alias("a"), F.max("fy").alias("b")).first()
    if years["a"] == years["b"]:
        return fit_with(frame, 0.3)
    early, late = frame.where(F.col("fy") < years["b"]), frame.where(F.col("fy") == years["b"])
    losses = {c: fit_with(early, c).predict(late).agg(log_loss("p", "y").alias("l")).first()["l"] for c in PENALTIES}
    return fit_with(frame, min(losses, key=lambda c: (losses[c], c)))


def evaluate(df: DataFrame, p: str, y: str, *groups: str) -> DataFrame:
    """n, positives, base rate, mean p, AUC by rank sums, Brier score and log loss per group."""
    base = df.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(y).alias("positives"), F.round(F.avg(y), 6).alias("base_rate"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))), 6).alias("brier"), F.round(log_loss(p, y), 6).alias("log_loss"))
    return base.join(auc(df, p, y, *groups).withColumn("auc", F.round("auc", 6)), list(groups))


_EVAL = "e AS (SELECT segment, p, CAST(v36 >= 4 AS INTEGER) AS y FROM stores), a AS (SELECT segment, y, rank() OVER (PARTITION BY segment ORDER BY p) + (count(*) OVER (PARTITION BY segment, p) - 1) / 2.0::DOUBLE AS r FROM e), u AS (SELECT segment, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM a GROUP BY 1)"


@query("ml6_evaluate", f"WITH {STORES}, {_EVAL} SELECT segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS base_rate, round(avg(p), 6) AS mean_p, min(auc) AS auc, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss FROM e JOIN u USING (segment) GROUP BY segment")
def evaluate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of a score per outlet type."""
    return evaluate(stores(spark, sf_dir).withColumn("y", (F.col("v36") >= 4).cast("int")), "p", "y", "segment")


@query("ml4_fit_coefficients")
def fit_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the model with the penalty that the last year chose, the strongest first (ML3 to ML5)."""
    model = fit(settled(training_frame(spark, sf_dir)))
    rows = [(k, name, float(round(c, 4)), model.c) for k, (name, c) in enumerate(model.coefficients().items(), 1)]
    return spark.createDataFrame(rows, "place int, feature string, coefficient double, c double")


@query("ml5_predicted_by_year")
def predicted_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted model's probabilities against what was seen, per fiscal year (ML5, ML6)."""
    frame = settled(training_frame(spark, sf_dir))
    return evaluate(fit(frame).predict(frame), "p", "y", "fy")


@query("ml8_score_universe")
def score_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's latest risk, raw and shifted to a population rate of 26 % (ML8)."""
    frame = settled(training_frame(spark, sf_dir))
    scored = fit(frame).predict(frame)
    last = settled(scored.groupBy("entity").agg(F.max_by("p", F.struct("dn", "orderkey", "line", "part", "qty")).alias("p_raw")))
    shift = find_shift(last, "p_raw", 0.26)
    return last.select("entity", F.round("p_raw", 5).alias("p_raw"), F.round(shifted(F.col("p_raw"), F.lit(1.0), F.lit(shift)), 5).alias("p"), F.round(F.lit(shift), 4).alias("calibration_shift"))


_SCORERS = "s AS (UNPIVOT (SELECT fy, entity, dn, orderkey, line, part, y, CAST(n_prior_viol AS DOUBLE) AS prior_violators, CAST(CASE WHEN viol_12m >= 1 AND days_since_check >= 30 THEN 1000 + days_since_check ELSE 0 END AS DOUBLE) AS follow_up, CAST(days_since_check AS DOUBLE) AS days_since FROM hist) ON prior_violators, follow_up, days_since INTO NAME scorer VALUE score)"


@query(
    "ml10_backtest_rules",
    f"WITH {CHECKS}, {HISTORY}, {_SCORERS}, f AS (SELECT * FROM s WHERE fy > (SELECT min(fy) FROM hist)), r AS (SELECT fy, scorer, y, rank() OVER (PARTITION BY fy, scorer ORDER BY score) + (count(*) OVER (PARTITION BY fy, scorer, score) - 1) / 2.0::DOUBLE AS rk, row_number() OVER (PARTITION BY fy, scorer ORDER BY score DESC, entity, dn, orderkey, line, part, y) <= greatest(round_even(0.1 * count(*) OVER (PARTITION BY fy, scorer), 0), 1) AS top FROM f) SELECT fy, scorer, count(*) AS n, CAST(sum(y) AS BIGINT) AS violations, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE)), 6) AS auc, round(avg(CASE WHEN top THEN y END) / avg(y), 6) AS lift FROM r GROUP BY ALL",
)
def backtest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scorers replayed on each later year: AUC and lift of the top tenth (ML9, ML10, AG17)."""
    log = checks(spark, sf_dir).where("up")
    first = log.agg(F.min("fy").alias("first"))  # one row
    h = with_history(log).join(F.broadcast(first)).where("fy > first")
    due = F.when((F.col("viol_12m") >= 1) & (F.col("days_since_check") >= 30), 1000 + F.col("days_since_check")).otherwise(0).cast("double")
    wide = h.select("fy", "entity", "dn", "orderkey", "line", "part", "y", F.col("n_prior_viol").cast("double").alias("prior_violators"), due.alias("follow_up"), F.col("days_since_check").cast("double").alias("days_since"))
    s = wide.unpivot(["fy", "entity", "dn", "orderkey", "line", "part", "y"], ["prior_violators", "follow_up", "days_since"], "scorer", "score")
    ties = ["entity", "dn", "orderkey", "line", "part", "y"]
    base = s.groupBy("fy", "scorer").agg(F.count("*").alias("n"), F.sum("y").alias("violations"))
    out = base.join(auc(s, "score", "y", "fy", "scorer"), ["fy", "scorer"]).join(lift_at(s, "score", "y", 0.1, ties, "fy", "scorer"), ["fy", "scorer"])
    return out.select("fy", "scorer", "n", "violations", F.round("auc", 6).alias("auc"), F.round("lift", 6).alias("lift"))


@query("ml10_backtest_model")
def backtest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model trained on all earlier years, its penalty searched on the last of them, and scored on each year (ML10)."""
    frame = settled(training_frame(spark, sf_dir))
    years = sorted(r["fy"] for r in frame.select("fy").distinct().collect())  # a row per year
    out = None
    for year in years[1:]:
        test = fit(frame.where(F.col("fy") < year)).predict(frame.where(F.col("fy") == year)).select("fy", "y", "p", "entity", "dn")
        out = test if out is None else out.unionByName(test)
    out = settled(out if out is not None else frame.limit(0).select("fy", "y", F.lit(0.0).alias("p"), "entity", "dn"))
    return evaluate(out, "p", "y", "fy").join(lift_at(out, "p", "y", 0.1, ["entity", "dn"], "fy").withColumn("lift", F.round("lift", 5)), "fy")


def logit(x: float) -> float:
    """Log odds."""
    return math.log(x / (1 - x))
