"""Rolling means cost the same for every window, smoothing sorts once, and both stand odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.series import rolling_mean, rolling_means, smoothed_any
from marlstone.plans import market, strategies


def of(values):
    return [(1, k, v) for k, v in enumerate(values)]


SCHEMA = "symbol long, d long, close double"


def test_smoothing_sorts_once(spark, sf):
    """The sort for the bars' open price serves all passes."""
    plan = strategies.reg_smoothed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_no_sliding_means(spark, sf):
    assert "avg(close" not in market.ind_calc_all(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("window", [1, 2, 20, 240])
def test_rolling_mean(spark, window):
    rng = np.random.default_rng(window)
    values = np.round(rng.uniform(1, 3000, 5000), 9)
    values[:300] *= 1e9  # what has left the window must leave no trace
    got = spark.createDataFrame(of(values.tolist()), SCHEMA).select("d", rolling_mean(F.col("close"), window).alias("m")).orderBy("d").collect()
    for k, r in enumerate(got):
        if k < window - 1:
            assert r.m is None
        else:
            want = math.fsum(values[k - window + 1 : k + 1]) / window
            assert abs(r.m - want) <= 1e-12 * want


def test_rolling_mean_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    values = [1.0, None, 3.0, 5.0, inf, 1.0, 2.0, nan, 4.0, 6.0, -inf, inf, 1.0, 1.0, -inf, 2.0, None]
    df = spark.createDataFrame(of(values), SCHEMA)
    got = [r.m for r in df.select("d", rolling_mean(F.col("close"), 2).alias("m")).orderBy("d").collect()]
    many = [r.m2 for r in rolling_means(df, "close", [2, 3], "m").orderBy("d").collect()]
    want = [None if k == 0 or None in values[k - 1 : k + 1] else sum(values[k - 1 : k + 1]) / 2 for k in range(len(values))]
    assert list(map(repr, got)) == list(map(repr, want)) == list(map(repr, many))


def test_smoothing_of_odd_values(spark):
    for values in ([1.0, 2.0, math.inf, 3.0] + [1.0] * 400, [1.0, math.nan] + [2.0] * 400, [1.0, None] + [2.0] * 400, [None, 1.0], []):
        got = [r.y for r in smoothed_any(spark.createDataFrame(of(values), SCHEMA), "close", 0.5, "y").orderBy("d").collect()]
        want, y = [], None
        for k, v in enumerate(values):
            y = v if k == 0 else None if y is None or v is None else 0.5 * v + 0.5 * y
            want.append(y)
        assert [g if g is None or g != g else pytest.approx(g, rel=1e-12) for g in got] == want or list(map(repr, got)) == list(map(repr, want))
