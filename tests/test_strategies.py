"""Strategy definitions: refusals, compilation, fills; smoothing of series beyond the range of doubles; registry of indicators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from marlstone.functions.indicators import INDICATORS
from marlstone.functions.series import smoothed_any
from marlstone.operators import strategy as S

GOOD = {"name": "s", "entry": [{"gt": ["close", "open"]}], "exit": [{"lt": ["close", "open"]}], "ranking": [{"factor": "amount", "weight": 1}]}
DAY = dt.date(2024, 1, 1)


def codes(**change):
    return list(S.refusals(S.Strategy.of(GOOD | change), S.BAR))


@pytest.mark.parametrize("fill", S.FILLS)
def test_a_good_definition_is_accepted_with_every_fill(fill):
    assert codes(execution={"signal_at": "close", "fill_at": fill}) == []


@pytest.mark.parametrize(
    "change, code",
    [
        ({"entry": []}, S.RULES_MISSING),
        ({"exit": []}, S.RULES_MISSING),
        ({"execution": {"signal_at": "open", "fill_at": "next_open"}}, S.TIMELINE),
        ({"execution": {"signal_at": "close", "fill_at": "close"}}, S.TIMELINE),
        ({"execution": {}}, S.TIMELINE),
        ({"ranking": []}, S.RANKING),
        ({"entry": [{"rising": ["close", -1]}]}, S.AHEAD),
        ({"entry": [{"all": [{"gt": ["close", "open"]}, {"rolling_max": ["close", 0]}]}]}, S.AHEAD),
        ({"entry": [{"count_true": [{"gt": ["close", "open"]}, 2.5, 1]}]}, S.AHEAD),
        ({"entry": [{"near": ["close", "open"]}]}, S.FAULTY),
        ({"entry": [{"gt": ["close", "tomorrow"]}]}, S.FAULTY),
        ({"entry": ["close > open"]}, S.FAULTY),
        ({"ranking": [{"factor": "nothing", "weight": 1}]}, S.FAULTY),
        ({"ranking": [{"factor": "amount", "weight": True}]}, S.FAULTY),
        ({"portfolio": {"top": 0}}, S.FAULTY),
        ({"portfolio": {}}, S.FAULTY),
        ({"execution": {"signal_at": "close", "fill_at": "limit_price", "limit_offset": "x"}}, S.FAULTY),
    ],
)
def test_refusals_have_their_code(change, code):
    assert codes(**change) == [code]


@pytest.mark.parametrize("word", S.BANNED)
def test_banned_texts_are_found_in_any_case_and_place(word):
    assert S.NOT_DSL in codes(universe=[{"gt": [word.upper(), 1]}])


def test_the_field_execution_is_no_banned_text():
    assert codes(portfolio={"top": 1, "note": "python"}) == []


def test_all_faults_are_told_and_compiling_names_them():
    bad = S.Strategy.of(GOOD | {"exit": [], "ranking": [], "entry": [{"falling": ["close", -2]}]})
    assert list(S.refusals(bad, S.BAR)) == [S.RULES_MISSING, S.RANKING, S.AHEAD]
    with pytest.raises(ValueError, match="LOOKS_AHEAD: entry 0: falling over -2 rows"):
        S.compile_strategy(bad, S.BAR)


def frame(spark, rows):
    schema = "symbol long, d date, open double, high double, low double, close double, volume double, amount double"
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=k), *rest) for s, k, *rest in rows], schema)


def fills(spark, rows, **change):
    got = S.signals(frame(spark, rows), [S.Strategy.of(GOOD | change)]).orderBy("d", "symbol").collect()
    return [(r.symbol, (r.d - DAY).days, r.enters, r.place, r.exits, r.fill_d and (r.fill_d - DAY).days, r.price, r.reason) for r in got]


UP = [(1, 0, 10.0, 12.0, 9.0, 11.0, 5.0, 50.0), (1, 3, 11.0, 13.0, 10.5, 10.8, 4.0, 46.0), (1, 4, 11.5, 12.0, 11.4, 11.5, 0.0, 0.0)]


@pytest.mark.parametrize("fill, price", [("next_open", 11.0), ("next_close", 10.8), ("vwap", 11.5), ("limit_price", 11.0)])
def test_fills_are_of_the_next_session(spark, fill, price):
    got = fills(spark, UP, execution={"signal_at": "close", "fill_at": fill})
    # The exit's next session is suspended; the last bar neither rises nor falls.
    assert got == [(1, 0, True, 1, False, 3, price, None), (1, 3, False, None, True, 4, None, "SUSPENDED")]


def test_a_limit_outside_the_next_bar_is_not_reached(spark):
    got = fills(spark, UP[:2], execution={"signal_at": "close", "fill_at": "limit_price", "limit_offset": -0.5})
    assert [(r[5], r[7]) for r in got] == [(3, "LIMIT_PRICE_NOT_REACHED"), (None, "NO_NEXT_SESSION")]


def test_places_by_score_then_symbol_up_to_the_top(spark):
    rows = [(s, 0, 1.0, 2.0, 1.0, 2.0, 1.0, a) for s, a in ((4, 7.0), (3, 9.0), (2, 7.0), (1, None), (5, 1.0))]
    got = fills(spark, rows, portfolio={"top": 3})
    assert [(r[0], r[3]) for r in sorted(got, key=lambda r: r[3])] == [(3, 1), (2, 2), (4, 3)]


def test_undecided_rules_and_empty_frames(spark):
    assert fills(spark, [(1, 0, None, 2.0, 1.0, 2.0, 1.0, 1.0)]) == []
    assert fills(spark, []) == []


def test_signals_up_to_a_day_do_not_change_with_later_bars(spark):
    rng = np.random.default_rng(5)
    rows = [(s, k, *map(float, (o := rng.uniform(9, 11), o + 1, o - 1, o + rng.uniform(-1, 1))), 5.0, float(rng.integers(1, 9))) for s in range(6) for k in range(12)]
    whole = [r[:5] for r in fills(spark, rows) if r[1] <= 7]
    assert whole == [r[:5] for r in fills(spark, [r for r in rows if r[1] <= 7])]


@pytest.mark.parametrize("window", [2, 12, 400])
def test_smoothing_of_long_series_equals_the_recurrence(spark, window):
    rng = np.random.default_rng(window)
    x = {1: rng.uniform(1, 100, 4000), 2: rng.uniform(1, 100, 1), 3: rng.uniform(1e-3, 1e6, 1111)}
    rows = [(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)]
    got = smoothed_any(spark.createDataFrame(rows, "symbol long, d long, close double"), "close", 2 / (window + 1), "y").toPandas()
    assert list(got.columns) == ["symbol", "d", "close", "y"]
    for k, xs in x.items():
        want = pd.Series(xs).ewm(span=window, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got[got.symbol == k].sort_values("d").y.to_numpy(), want, rtol=1e-9)


def test_smoothing_ends_at_a_missing_value(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (2, 0, 5.0)], "symbol long, d long, close double")
    got = {(r.symbol, r.d): r.y for r in smoothed_any(df, "close", 0.5, "y").collect()}
    assert got == {(1, 0): 1.0, (1, 1): None, (1, 2): None, (2, 0): 5.0}


def test_registry_checks_parameters_and_columns(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "symbol long, d long, close double")
    for name, given in (("ema", {"window": 1}), ("ema", {"window": 1001}), ("ema", {}), ("macd", {"fast": 26, "slow": 12, "signal": 9}), ("macd", {"fast": 12})):
        with pytest.raises(ValueError):
            INDICATORS.apply(df, {"x": (name, given)})
    with pytest.raises(ValueError, match="lacks"):
        INDICATORS.apply(df, {"x": ("rolling_std", {"window": 5})})
    with pytest.raises(ValueError, match="isn't one column"):
        INDICATORS.get("ema").build(window=5)
    got = INDICATORS.apply(df, {"m": ("macd", {"fast": 12, "slow": 26, "signal": 9}), "e": ("ema", {"window": 5})}).first()
    assert (got.m_dif, got.m_dea, got.m_hist, got.e) == (0.0, 0.0, 0.0, 1.0)


def test_report_without_figures_or_months_says_so(spark):
    from marlstone.plans.strategies import report

    names = ["last", "benchmark", "total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown"]
    metrics = spark.createDataFrame([("a", *[None] * 7), ("b", 1234567.5, 1e6, 0.2345, -0.1, 0.3, 1.25, -0.5)], "k string, " + ", ".join(f"{n} double" for n in names))
    months = spark.createDataFrame([("b", "2024-02", None), ("b", "2024-01", 0.01)], "k string, month string, ret double")
    text = {r.k: r.text.split("\n") for r in report(metrics, months, "k").collect()}
    assert text["a"][4:] == ["- 期末净值：暂无", "- 基准期末净值：暂无", "- 总收益率：暂无", "- 年化收益：暂无", "- 年化波动：暂无", "- 夏普比率：0.00", "- 最大回撤：暂无"]
    assert text["b"][4:7] == ["- 期末净值：1,234,567.50", "- 基准期末净值：1,000,000.00", "- 总收益率：23.45%"]
    assert text["b"][-2:] == ["| 2024-01 | 1.00% |", "| 2024-02 | 暂无 |"]
