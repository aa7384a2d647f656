"""Histories: boundaries of the lag and the windows, and that the future never leaks."""

import datetime as dt

from pyspark.sql import functions as F

from sparkwarden.operators.history import fiscal_rates, scoring_frame, with_history

DAY0 = dt.date(1970, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(e, (dt.date.fromisoformat(d) - DAY0).days, y, dt.date.fromisoformat(d).year, "WL" if y else "NONE") for e, d, y in rows], "entity string, dn int, y int, fy int, outcome string")


ROWS = [("A", "2020-01-01", 1), ("A", "2020-06-01", 0), ("A", "2021-03-01", 1), ("A", "2022-01-01", 0), ("B", "2021-01-01", 0)]


def at(df, day):
    return df.where(F.col("dn") == (dt.date.fromisoformat(day) - DAY0).days).where("entity = 'A'").first()


def test_counts_as_of_a_check(spark):
    row = at(with_history(log(spark, ROWS)), "2021-03-01")
    assert (row.n_prior_checks, row.n_prior_viol, row.viol_12m, row.viol_24m) == (2, 1, 0, 1)


def test_scoring_sees_records_up_to_the_lag(spark):
    rows = {r.entity: r for r in scoring_frame(log(spark, ROWS), "2021-04-15").collect()}
    assert (rows["A"].n_checks, rows["A"].viol_12m) == (3, 1)
    assert rows["A"].days_since_check == 15  # from the cutoff


def test_a_later_outcome_changes_no_earlier_feature(spark):
    changed = [*ROWS[:3], ("A", "2022-01-01", 1), ROWS[4]]
    columns = ["n_prior_viol", "viol_36m", "days_since_viol", "n_prior_checks"]
    a, b = ([tuple(r) for r in with_history(log(spark, x)).select("entity", "dn", *columns).orderBy("entity", "dn").collect()] for x in (ROWS, changed))
    assert a == b


def test_lag_is_inclusive_and_windows_are_exclusive_below(spark):
    rows = [("A", "2020-01-01", 1), ("A", "2020-01-31", 0), ("A", "2021-01-29", 0), ("A", "2021-01-30", 0)]
    df = with_history(log(spark, rows))
    assert at(df, "2020-01-31").n_prior_checks == 1  # exactly the lag before
    assert at(df, "2021-01-29").viol_12m == 1  # 364 days before the cutoff
    assert at(df, "2021-01-30").viol_12m == 0  # 365 days before it


def test_same_day_records_are_alike(spark):
    df = with_history(log(spark, [("A", "2020-01-01", 1), ("A", "2020-03-01", 0), ("A", "2020-03-01", 1)]))
    assert {r.n_prior_viol for r in df.where("dn > 18300").collect()} == {1}


def test_no_history_gives_the_longest_gap(spark):
    row = at(with_history(log(spark, [("A", "2020-01-01", 1)])), "2020-01-01")
    assert (row.n_prior_checks, row.days_since_check, row.days_since_viol) == (0, 1825, 1825)


def test_years_with_few_checks_take_a_neighbours_rate(spark):
    few = [(2019, 1)] * 3 + [(2020, 1)] * 300 + [(2020, 0)] * 300 + [(2021, 0)] * 4
    df = spark.createDataFrame(few, "fy int, y int")
    assert [r.rate for r in fiscal_rates(df).orderBy("fy").collect()] == [0.5, 0.5, 0.5]
