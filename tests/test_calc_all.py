"""All series of the reference's calc_all, against its recursions, in a series longer than closed forms can take."""

import datetime as dt

import numpy as np
import pytest

from marlstone.plans import market

DAYS = 1800


def smooth(values, alpha, y=None):
    out = []
    for v in values:
        y = v if y is None else alpha * v + (1 - alpha) * y
        out.append(y)
    return out


@pytest.fixture
def walk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    close = np.round(100 + np.cumsum(rng.normal(0, 0.2, DAYS)), 4)
    close[40:60] = close[40]  # a stretch without any move
    high, low = close + np.where(np.arange(DAYS) // 20 == 2, 0, 0.5), close - np.where(np.arange(DAYS) // 20 == 2, 0, 0.25)
    rows = [(1, dt.date(2001, 1, 1) + dt.timedelta(days=k), float(c), float(h), float(w), float(c), 1000.0 + k % 7, 1.0) for k, (c, h, w) in enumerate(zip(close, high, low, strict=True))]
    schema = "symbol long, d date, open double, high double, low double, close double, volume double, amount double"
    monkeypatch.setattr(market, "bars", lambda s, sf: s.createDataFrame(rows, schema).repartition(3))
    return high.tolist(), low.tolist(), close.tolist()


def test_all_series(spark, sf):
    names = {"ma5", "ma10", "ma20", "ma60", "ma120", "ma240", "stl", "ltl", "volume_ma5", "volume_ma10", "volume_ratio20", "dif", "dea", "macd", "kdj_k", "kdj_d", "kdj_j"}
    assert set(market.ind_calc_all(spark, sf).columns) == names | {"symbol", "d"}


def test_stl_and_kdj(spark, walk):
    high, low, close = walk
    got = market.ind_calc_all(spark, "").orderBy("d").collect()
    stl = smooth(smooth(close, 2 / 11), 2 / 11)
    rsv = []
    for k in range(8, DAYS):
        top, bottom = max(high[k - 8 : k + 1]), min(low[k - 8 : k + 1])
        rsv.append(50.0 if top == bottom else (close[k] - bottom) / (top - bottom) * 100)
    k_line = smooth(rsv, 1 / 3, 50.0)
    d_line = smooth(k_line, 1 / 3, 50.0)
    assert len(got) == DAYS
    assert [r.stl for r in got] == pytest.approx(stl, abs=1.1e-4)
    assert all(r.kdj_k is None and r.kdj_d is None and r.kdj_j is None for r in got[:8])
    assert [r.kdj_k for r in got[8:]] == pytest.approx(k_line, abs=1.1e-4)
    assert [r.kdj_d for r in got[8:]] == pytest.approx(d_line, abs=1.1e-4)
    assert [r.kdj_j for r in got[8:]] == pytest.approx([3 * k - 2 * d for k, d in zip(k_line, d_line, strict=True)], abs=1.1e-4)
