"""Histories that are safe from leakage: what was known of an entity when it was checked.

All features of a check look at records up to ``LAG`` days before it, by RANGE frames over whole days, so that records
of the same day are treated alike.  Days since an event count from the cutoff, not from the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions.text import name_key
from sparkwarden.plans.registry import query
from sparkwarden.sources.tables import CHECKS, DEPTH_WEIGHTS, LAMBDA, POINTS, checks, table

#: Days until a decision may be used, days of the trailing windows, and the longest gap that is told apart.
LAG, YEAR, NEVER = 30, 365, 1825


def before(days: int | None = None, key: str = "entity", day: str = "dn"):
    """The window of records up to the cutoff; with ``days``, those of the last days before it."""
    start = Window.unboundedPreceding if days is None else -(LAG + days - 1)
    return Window.partitionBy(key).orderBy(day).rangeBetween(start, -LAG)


def daily_history(log: DataFrame) -> DataFrame:
    """Per entity and day: counts, trailing counts and days since, as of the day's cutoff.

    All records of a day are alike, so the windows run over daily totals: an entity has a row per day at most, however
    many records it has, and a hot entity's records are summed before the shuffle.
    """
    daily = log.groupBy("entity", "dn").agg(F.count("y").alias("_n"), F.sum("y").alias("_v"))
    past, cutoff = before(), F.col("dn") - LAG
    since = lambda last: F.coalesce(F.least(cutoff - last, F.lit(NEVER)), F.lit(NEVER)).cast("int")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint")
    return daily.select(
        "entity",
        "dn",
        total("_n", past).alias("n_prior_checks"),
        total("_v", past).alias("n_prior_viol"),
        *[total("_v", before(k * YEAR)).alias(f"viol_{12 * k}m") for k in (1, 2, 3)],
        since(F.max("dn").over(past)).alias("days_since_check"),
        since(F.max(F.when(F.col("_v") > 0, F.col("dn"))).over(past)).alias("days_since_viol"),
    )


FEATURES = ("n_prior_checks", "n_prior_viol", "viol_12m", "viol_24m", "viol_36m", "days_since_check", "days_since_viol")


HISTORY = f"""hist AS (SELECT entity, dn, day, fy, y, up, part, orderkey, line,
 count(y) OVER past AS n_prior_checks, CAST(coalesce(sum(y) OVER past, 0) AS BIGINT) AS n_prior_viol,
 CAST(coalesce(sum(y) OVER (PARTITION BY entity ORDER BY dn RANGE BETWEEN 394 PRECEDING AND 30 PRECEDING), 0) AS BIGINT) AS viol_12m,
 CAST(coalesce(sum(y) OVER (PARTITION BY entity ORDER BY dn RANGE BETWEEN 759 PRECEDING AND 30 PRECEDING), 0) AS BIGINT) AS viol_24m,
 CAST(coalesce(sum(y) OVER (PARTITION BY entity ORDER BY dn RANGE BETWEEN 1124 PRECEDING AND 30 PRECEDING), 0) AS BIGINT) AS viol_36m,
 CAST(coalesce(least(dn - 30 - max(dn) OVER past, 1825), 1825) AS INTEGER) AS days_since_check,
 CAST(coalesce(least(dn - 30 - max(CASE WHEN y = 1 THEN dn END) OVER past, 1825), 1825) AS INTEGER) AS days_since_viol
 FROM checks WHERE up WINDOW past AS (PARTITION BY entity ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING))"""


@query("wn1_history_features", f"WITH {CHECKS}, {HISTORY} SELECT entity, dn, y, n_prior_checks, n_prior_viol, viol_12m, viol_24m, viol_36m, days_since_check, days_since_viol FROM hist")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag-guarded history of each undercover check."""
    return with_history(checks(spark, sf_dir).where("up").select("entity", "dn", "y")).select("entity", "dn", "y", *FEATURES)


def with_history(log: DataFrame) -> DataFrame:
    """log (entity, dn, y) with the columns of its days' history; rows without an entity have none.

    The join back is on entity and day; adaptive execution splits a hot entity's rows.
    """
    return log.join(daily_history(log), ["entity", "dn"], "left")


@query(
    "wn4_next_record",
    f"WITH {CHECKS}, n AS (SELECT entity, dn, orderkey, line, part, qty, y, lead(dn) OVER (PARTITION BY entity ORDER BY dn, orderkey, line, part, qty, y) AS nxt FROM checks) SELECT entity, dn, orderkey, line, part, qty, CAST(nxt - dn AS INTEGER) AS days_to_next FROM n WHERE y = 1",
)
def next_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each violation to the entity's next record of any kind; null where none follows."""
    w = Window.partitionBy("entity").orderBy("dn", "orderkey", "line", "part", "qty", "y")
    return checks(spark, sf_dir).withColumn("days_to_next", (F.lead("dn").over(w) - F.col("dn")).cast("int")).where("y = 1").select("entity", "dn", "orderkey", "line", "part", "qty", "days_to_next")


@query(
    "wn5_prior_outcome",
    """SELECT event_id, user_id, lag(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS prior_y, date_diff('second', lag(ts) OVER w, ts) AS gap_s,
 row_number() OVER w - 1 AS n_prior, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v_prior,
 round((coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1) / CAST(row_number() OVER w + 1 AS DOUBLE), 6) AS smoothed
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def prior_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous outcome, gap, number of prior records and violations, and the smoothed prior rate (v + 1) / (n + 2)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = (F.col("event_type") == "error").cast("int")
    v, n = F.coalesce(F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"), F.row_number().over(w) - 1
    gap = F.date_trunc("second", "ts").cast("bigint") - F.lag(F.date_trunc("second", "ts").cast("bigint")).over(w)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lag(y).over(w).alias("prior_y"), gap.alias("gap_s"), n.cast("bigint").alias("n_prior"), v.alias("v_prior"), F.round((v + 1) / (n + 2), 6).alias("smoothed"))


FY_RATES = """fy_n AS (SELECT fy, avg(y) AS rate, count(*) AS n FROM checks WHERE up GROUP BY fy), fy_ok AS (SELECT fy, n, CASE WHEN n >= 500 THEN rate END AS rate FROM fy_n),
 fy_f AS (SELECT fy, n, last_value(rate IGNORE NULLS) OVER (ORDER BY fy) AS f FROM fy_ok),
 fy_rates AS (SELECT fy, n, coalesce(f, first_value(f IGNORE NULLS) OVER (ORDER BY fy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM fy_f)"""


def fiscal_rates(log: DataFrame, least: int = 500) -> DataFrame:
    """Violation rate per fiscal year; years with few checks take the last rate before, else the first after.

    The windows run over one row per year.
    """
    w = Window.orderBy("fy")
    rates = log.groupBy("fy").agg(F.avg("y").alias("rate"), F.count("*").alias("n")).withColumn("rate", F.when(F.col("n") >= least, F.col("rate")))
    filled = rates.withColumn("rate", F.last("rate", True).over(w))
    return filled.withColumn("rate", F.coalesce("rate", F.first("rate", True).over(w.rowsBetween(0, Window.unboundedFollowing))))


@query("ag7_fiscal_rates", f"WITH {CHECKS}, {FY_RATES} SELECT fy, n, round(rate, 6) AS rate FROM fy_rates")
def fiscal_rates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior fiscal-year rates with filled gaps."""
    return fiscal_rates(checks(spark, sf_dir).where("up")).select("fy", "n", F.round("rate", 6).alias("rate"))


def prior_rate(log: DataFrame, rates: DataFrame) -> DataFrame:
    """The greatest-lower-bound lookup: for each fy of log the rate of the latest year strictly before, else of the first."""
    w = Window.orderBy("fy")
    years = rates.select("fy", "rate").withColumn("prior_fy_rate", F.coalesce(F.lag("rate").over(w), F.col("rate")))
    return log.join(F.broadcast(years.select("fy", "prior_fy_rate")), "fy", "left")  # one row per year


@query("jn10_prior_year_rate", f"WITH {CHECKS}, {FY_RATES}, g AS (SELECT fy, coalesce(lag(rate) OVER (ORDER BY fy), rate) AS prior_fy_rate FROM fy_rates) SELECT c.entity, c.fy, count(*) AS n, round(min(g.prior_fy_rate), 6) AS prior_fy_rate FROM checks c JOIN g USING (fy) WHERE c.up GROUP BY ALL")
def prior_year_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest-lower-bound join on fiscal years."""
    log = checks(spark, sf_dir).where("up")
    return prior_rate(log, fiscal_rates(log)).groupBy("entity", "fy").agg(F.count("*").alias("n"), F.round(F.min("prior_fy_rate"), 6).alias("prior_fy_rate"))


def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per undercover check with all model features and the label y."""
    log = checks(spark, sf_dir).where("up")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), name_key(F.col("p_name")).alias("chain"), F.col("p_type").alias("outlet"))
    named = log.join(part, "part", "left")
    sizes = named.where("chain IS NOT NULL").select("chain", "entity").distinct().groupBy("chain").agg(F.count("*").alias("chain_size"))
    frame = prior_rate(with_history(named), fiscal_rates(log)).join(sizes, "chain", "left")
    return frame.withColumns(
        {
            "chain_size": F.coalesce("chain_size", F.lit(1)),
            "log_checks": F.log1p("n_prior_checks"),
            "prior_share": F.coalesce(F.try_divide("n_prior_viol", F.col("n_prior_checks").cast("double")), F.lit(0.0)),
            "log_chain": F.log1p(F.coalesce("chain_size", F.lit(1))),
        }
    )


@query(
    "ml1_training_frame",
    f"""WITH {CHECKS}, {HISTORY}, {FY_RATES}, g AS (SELECT fy, coalesce(lag(rate) OVER (ORDER BY fy), rate) AS prior_fy_rate FROM fy_rates),
 nm AS (SELECT p_partkey AS part, trim(regexp_replace(regexp_replace(regexp_replace(upper(p_name), '[#0-9]+', ' ', 'g'), '[^A-Z& ]', ' ', 'g'), '\\s+', ' ', 'g')) AS chain, p_type AS outlet FROM part),
 sz AS (SELECT chain, count(DISTINCT entity) AS chain_size FROM checks JOIN nm USING (part) WHERE up GROUP BY chain)
 SELECT entity, dn, y, outlet, chain, CAST(coalesce(chain_size, 1) AS BIGINT) AS chain_size, round(prior_fy_rate, 6) AS prior_fy_rate, viol_24m, days_since_viol, round(ln(1 + n_prior_checks), 6) AS log_checks, round(coalesce(n_prior_viol / nullif(CAST(n_prior_checks AS DOUBLE), 0), 0), 6) AS prior_share
 FROM hist LEFT JOIN nm USING (part) LEFT JOIN sz USING (chain) LEFT JOIN g USING (fy)""",
)
def training_frame_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training frame: history windows, chain sizes, prior rates, outlet types."""
    f = training_frame(spark, sf_dir)
    return f.select("entity", "dn", "y", "outlet", "chain", "chain_size", F.round("prior_fy_rate", 6).alias("prior_fy_rate"), "viol_24m", "days_since_viol", F.round("log_checks", 6).alias("log_checks"), F.round("prior_share", 6).alias("prior_share"))


def scoring_frame(log: DataFrame, as_of: str) -> DataFrame:
    """Features per entity as of a day: one aggregation over the records up to the cutoff."""
    cutoff = F.unix_date(F.lit(as_of).cast("date")) - LAG
    known, y = log.where(F.col("dn") <= cutoff), F.col("y")
    recent = lambda days: F.coalesce(F.sum(F.when(F.col("dn") > cutoff - days, y)), F.lit(0)).cast("bigint")
    points = F.coalesce(F.sum(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])[F.col("outcome")]), F.lit(0.0))
    return known.groupBy("entity").agg(
        F.count("*").alias("n_checks"),
        F.sum("y").alias("n_viol"),
        recent(YEAR).alias("viol_12m"),
        recent(2 * YEAR).alias("viol_24m"),
        recent(3 * YEAR).alias("viol_36m"),
        F.least(cutoff - F.max("dn"), F.lit(NEVER)).alias("days_since_check"),
        F.coalesce(F.least(cutoff - F.max(F.when(y == 1, F.col("dn"))), F.lit(NEVER)), F.lit(NEVER)).alias("days_since_viol"),
        points.alias("severity_points"),
    )


SCORING = """scoring AS (SELECT entity, count(*) AS n_checks, CAST(sum(y) AS BIGINT) AS n_viol,
 CAST(coalesce(sum(CASE WHEN dn > cut - 365 THEN y END), 0) AS BIGINT) AS viol_12m, CAST(coalesce(sum(CASE WHEN dn > cut - 730 THEN y END), 0) AS BIGINT) AS viol_24m, CAST(coalesce(sum(CASE WHEN dn > cut - 1095 THEN y END), 0) AS BIGINT) AS viol_36m,
 CAST(least(min(cut) - max(dn), 1825) AS INTEGER) AS days_since_check, CAST(coalesce(least(min(cut) - max(CASE WHEN y = 1 THEN dn END), 1825), 1825) AS INTEGER) AS days_since_viol,
 coalesce(sum(CASE outcome WHEN 'WL' THEN 1.0::DOUBLE WHEN 'CMP' THEN 2.0::DOUBLE WHEN 'NTSO' THEN 4.0::DOUBLE END), 0) AS severity_points
 FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', DATE '2001-09-01') - 30 AS INTEGER) AS cut FROM checks WHERE up) WHERE dn <= cut GROUP BY entity)"""


@query("ml2_scoring_frame", f"WITH {CHECKS}, {SCORING} SELECT * FROM scoring")
def scoring_frame_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every entity as of 2001-09-01."""
    return scoring_frame(checks(spark, sf_dir).where("up"), "2001-09-01")


@query(
    "entity_risk_ranking",
    f"""WITH {CHECKS}, {SCORING}, r AS (SELECT s.*, (n_viol + 1) / CAST(n_checks + 2 AS DOUBLE) AS p, least(severity_points, 8) / 8 AS h,
 CASE least(viol_36m, 4) WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * least(days_since_check / 365.0::DOUBLE, 1) AS det FROM scoring s)
 SELECT entity, s_name AS name, n_name AS tract, r_name AS city, n_checks, round(p, 6) AS p, round(h * p + 0.25 * det, 6) AS prize
 FROM r JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey ORDER BY h * p + 0.25 * det DESC, entity LIMIT 50""",
)
def entity_risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: as-of features of every entity, smoothed risk, prize, place, and the 50 highest prizes."""
    scores = scoring_frame(checks(spark, sf_dir).where("up"), "2001-09-01")
    weights = F.array(*[F.lit(w) for w in DEPTH_WEIGHTS])
    det = F.element_at(weights, F.least("viol_36m", F.lit(4)).cast("int") + 1) * F.least(F.col("days_since_check") / 365.0, F.lit(1.0))
    p = (F.col("n_viol") + 1) / (F.col("n_checks") + 2)
    ranked = scores.select("entity", "n_checks", p.alias("p"), (F.least("severity_points", F.lit(8.0)) / 8 * p + LAMBDA * det).alias("score"))
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = ranked.join(supplier, F.col("s_suppkey") == F.col("entity")).join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    top = placed.orderBy(F.desc("score"), "entity").limit(50)
    return top.select("entity", F.col("s_name").alias("name"), F.col("n_name").alias("tract"), F.col("r_name").alias("city"), "n_checks", F.round("p", 6).alias("p"), F.round("score", 6).alias("prize"))


@query(
    "jn9_as_of_join",
    f"""WITH {CHECKS} SELECT e.entity, e.at, count(c.dn) AS n_known, CAST(coalesce(sum(c.y), 0) AS BIGINT) AS v_known, max(c.dn) AS last_known
 FROM (SELECT DISTINCT s_suppkey AS entity, o.at FROM supplier, (SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', date_trunc('year', o_orderdate)) AS INTEGER) AS at FROM orders) o) e
 LEFT JOIN checks c ON c.entity = e.entity AND c.dn <= e.at - 30 GROUP BY ALL""",
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each entity at the start of each year: running totals per day, then the last before each point.

    Points and log are united and swept by one window per entity, so there is no range join.
    """
    years = table(spark, sf_dir, "orders").select(F.unix_date(F.to_date(F.date_trunc("year", "o_orderdate"))).alias("at")).distinct()
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity")).join(F.broadcast(years.groupBy().agg(F.collect_set("at").alias("ats"))))
    points = points.select("entity", F.explode("ats").alias("at")).select("entity", (F.col("at") - LAG).alias("dn"), "at", F.lit(None).cast("int").alias("y"))
    log = checks(spark, sf_dir).groupBy("entity", "dn").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    both = log.select("entity", "dn", F.lit(None).cast("int").alias("at"), "n", "y").unionByName(points.select("entity", "dn", "at", F.lit(None).cast("bigint").alias("n"), F.col("y").cast("bigint").alias("y")))
    w = Window.partitionBy("entity").orderBy("dn").rangeBetween(Window.unboundedPreceding, 0)
    swept = both.select("entity", "at", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_known"), F.coalesce(F.sum("y").over(w), F.lit(0)).alias("v_known"), F.max(F.when(F.col("n").isNotNull(), F.col("dn"))).over(w).alias("last_known"))
    return swept.where("at IS NOT NULL")


@query(
    "jn12_merged_history",
    f"""WITH {CHECKS}, k AS (SELECT s_nationkey AS licence, s_suppkey AS entity FROM supplier) SELECT licence, count(*) AS n_checks, CAST(sum(y) AS BIGINT) AS n_viol, min(dn) AS first_dn, max(dn) AS last_dn, count(DISTINCT entity) AS n_keys FROM k JOIN checks USING (entity) GROUP BY licence""",
)
def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of licences that have several location keys: explode the keys, join the log, group by licence."""
    keys = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("licence")).agg(F.collect_set("s_suppkey").alias("keys")).select("licence", F.explode("keys").alias("entity"))
    return keys.join(checks(spark, sf_dir), "entity").groupBy("licence").agg(F.count("*").alias("n_checks"), F.sum("y").alias("n_viol"), F.min("dn").alias("first_dn"), F.max("dn").alias("last_dn"), F.countDistinct("entity").alias("n_keys"))


@query(
    "fn19_state_features",
    f"WITH {CHECKS}, {HISTORY} SELECT least(viol_36m, 4) AS depth, viol_24m >= 1 AS targeted, count(*) AS n, round(avg(least(days_since_check / 365.0::DOUBLE, 1)), 6) AS recency, round(avg(CASE least(viol_36m, 4) WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * least(days_since_check / 365.0::DOUBLE, 1)), 6) AS gain FROM hist GROUP BY ALL",
)
def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalation depth, targeted flag, recency and deterrence gain of all checks."""
    h = with_history(checks(spark, sf_dir).where("up"))
    depth, recency = F.least("viol_36m", F.lit(4)), F.least(F.col("days_since_check") / 365.0, F.lit(1.0))
    gain = F.element_at(F.array(*[F.lit(w) for w in DEPTH_WEIGHTS]), depth.cast("int") + 1) * recency
    return h.groupBy(depth.alias("depth"), (F.col("viol_24m") >= 1).alias("targeted")).agg(F.count("*").alias("n"), F.round(F.avg(recency), 6).alias("recency"), F.round(F.avg(gain), 6).alias("gain"))
