"""Every query of the engine against its SQL; those without SQL must run, give rows and agree with a rerun."""

import pytest

from sparkwarden import catalog
from tests.conftest import DATA, same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Fits of several models and exact plans of many settings: run once, not twice.
SLOW = {"ml4_fit_coefficients", "sm5_gate_sweep", "rt11_team_sheet", "ml10_backtest_model", "ml8_score_universe", "sm8_realized_lift"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, name):
    rows = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    assert rows
    if name not in SLOW:
        assert rows == sorted(map(str, QUERIES[name](spark, DATA).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
