"""Equity curves that don't move, and ones with a single day: no division stops the job."""

import datetime as dt
import math

import pytest

from marlstone.plans import backtests as B
from marlstone.registry import REGISTRY

DAYS = [dt.date(1995, 1, 2) + dt.timedelta(days=30 * k) for k in range(80)]


@pytest.fixture
def flat(spark, monkeypatch):
    """Strategy 1 never trades, strategy 2 swings."""
    rows = [(1, d, 1e6) for d in DAYS] + [(2, d, 1e6 + 1e4 * (k % 7)) for k, d in enumerate(DAYS)]
    monkeypatch.setattr(B, "equity", lambda s, sf: s.createDataFrame(rows, "strategy long, d date, equity double"))


def test_flat_strategy_has_metrics(spark, sf, flat):
    got = {r.strategy: r for r in REGISTRY["ag_portfolio_metrics"].build(spark, sf).collect()}
    assert (got[1].n, got[1].total_return, got[1].annual_vol, got[1].max_drawdown) == (79, 0, 0, 0) and math.isnan(got[1].sharpe)
    assert got[2].sharpe > 0


def test_flat_strategy_is_evaluated(spark, sf, flat):
    got = {r.strategy: r for r in REGISTRY["fd_evaluate_strategy"].build(spark, sf).collect()}
    assert set(got) == {1, 2} and got[1].deflated_sharpe == 0 and got[1].adjusted_p == 1 and not got[1].passed


def test_single_day_and_zero(spark):
    rows = [(1, DAYS[0], 5.0), (2, DAYS[0], 0.0), (2, DAYS[1], 3.0)]
    got = {r.k: r for r in B.curve_metrics(spark.createDataFrame(rows, "k long, d date, v double"), "k").collect()}
    assert (got[1].n, got[1].total_return, got[1].annual_return, got[1].sharpe) == (0, 0, 0, None) and math.isinf(got[2].total_return)
