"""Column builders over an ordered series: full-frame rolling statistics, lags, exponential smoothing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_day() -> WindowSpec:
    """Rows of a symbol in the order of days."""
    return Window.partitionBy("symbol").orderBy("d")



def full(value: Column, window: int, how, over: WindowSpec | None = None) -> Column:
    """``how`` over the last ``window`` rows, null until there are so many values."""
    w = (over or by_day()).rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(w) == window, how(value).over(w))


#: Units of the parts of values that running sums add without error: the first up to a sum of 2^83, the second to 2^43.
UNITS = (2.0**30, 2.0**-10)
#: Weights by which one running count tells values, infinite ones and those of minus infinity apart; NaN counts as both.
PLUS, MINUS = 1 << 21, 1 << 42


def _parts(value: Column) -> tuple[Column, ...]:
    """What running sums add of a value: multiples of UNITS, the rest, and a count."""
    x, infinite = value.cast("double"), float("inf")
    rest = F.when(F.abs(x) < infinite, x).otherwise(0.0)
    parts = []
    for unit in UNITS:
        parts.append(F.rint(rest / unit) * unit)
        rest = rest - parts[-1]
    odd = F.when(x >= infinite, PLUS).otherwise(0) + F.when((x == -infinite) | F.isnan(x), MINUS).otherwise(0)
    return *parts, rest, F.when(x.isNull(), 0).otherwise(odd + 1).cast("long")


def _mean(sums: list[Column], before: list[Column], window: int) -> Column:
    """The mean of a window from the running sums of ``_parts`` up to its end and those before it, null if there are none."""
    *values, count = (s - F.coalesce(b, F.lit(0)) for s, b in zip(sums, before, strict=True))  # no code where b is never null
    plus, minus = F.pmod(count, F.lit(MINUS)) >= PLUS, count >= MINUS
    strange = F.when(plus & minus, float("nan")).when(plus, float("inf")).otherwise(float("-inf"))
    return F.when(count == window, sum(values[1:], values[0]) / window).when(F.pmod(count, F.lit(PLUS)) == window, strange)


def rolling_mean(value: Column, window: int) -> Column:
    """Mean of the last ``window`` rows (fewer than PLUS), null until there are so many values.

    It is made of differences of running sums, as a sliding frame is added up anew at every row. Multiples of UNITS and rests
    are summed apart, so that no digit is lost to values before the window, of which those that aren't finite don't count.
    """
    sums, before = ([F.sum(p).over(by_day().rowsBetween(Window.unboundedPreceding, end)) for p in _parts(value)] for end in (0, -window))
    return _mean(sums, before, window)


def rolling_means(df: DataFrame, value: str, windows: list[int], name: str) -> DataFrame:
    """Adds ``rolling_mean`` of ``value`` for each window, called by ``name`` and the window; they share their running sums,
    which are never null: the generated code of many means is short enough for Java to compile it."""
    rows, none = by_day(), F.lit(0)
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_sum{k}": F.coalesce(F.sum(p).over(so_far), none.cast("long" if k == len(UNITS) + 1 else "double")) for k, p in enumerate(_parts(F.col(value)))}
    df = df.withColumns(sums)
    zero = {c: 0 if c == f"_sum{len(UNITS) + 1}" else 0.0 for c in sums}
    before = {f"{c}_{w}": F.lag(c, w, zero[c]).over(rows) for c in sums for w in windows}
    df = df.withColumns(before)
    means = {f"{name}{w}": _mean([F.col(c) for c in sums], [F.col(f"{c}_{w}") for c in sums], w) for w in windows}
    return df.withColumns(means).drop(*sums, *before)


def rolling_ratio(value: Column, window: int) -> Column:
    mean = rolling_mean(value, window)
    return F.when(mean != 0, value / mean)


def change(value: Column, window: int = 1, over: WindowSpec | None = None) -> Column:
    before = F.lag(value, window).over(over or by_day())
    return F.when(before != 0, value / before - 1)


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles divide, where Spark stops with an error: over zero it is infinite by the sign of a, or NaN for 0 / 0."""
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan")).otherwise(a)
    return F.when(b == 0, by_zero).otherwise(a / b)


def cross_up(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """a was at most b and is above it now; false where any of the four is missing."""
    over = over or by_day()
    return F.coalesce((F.lag(a).over(over) <= F.lag(b).over(over)) & (a > b), F.lit(False))


def cross_down(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    over = over or by_day()
    return F.coalesce((F.lag(a).over(over) >= F.lag(b).over(over)) & (a < b), F.lit(False))


def longest_series(alpha: float) -> int:
    """Rows up to which ``smoothed`` stays in the range of doubles."""
    return int(700 / -math.log(1 - alpha))


def smoothed(value: Column, alpha: float, index: Column, seed: Column | None = None, over: WindowSpec | None = None) -> Column:
    """Exponential smoothing without a loop: y[0] = x[0] (or, with a seed s, y[-1] = s), y[t] = alpha x[t] + (1 - alpha) y[t-1].

    ``index`` counts the rows of a series from 0, nulls before it have a negative one. Series of more than
    ``longest_series(alpha)`` rows go through ``smooth_grouped``.
    """
    keep = 1 - alpha
    w = (over or by_day()).rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.when(index >= (0 if seed is not None else 1), value * F.pow(F.lit(keep), -index))
    total = F.coalesce(F.sum(scaled).over(w), F.lit(0.0))
    if seed is not None:
        start = seed * keep
    else:
        start = F.max(F.when(index == 0, value)).over(w)
    return F.when(index >= 0, F.pow(F.lit(keep), index) * (start + alpha * total))


#: What is older than where weights have faded to e^-FADED is left out: doubles can't tell it.
FADED = 80


def smoothed_any(
    df: DataFrame, value: str | list[str], alpha: float | list[float], out: str | list[str], key: str = "symbol", order: str = "d"
) -> DataFrame:
    """Adds the smoothing of ``smoothed`` (unseeded) for series of any length, by windows alone; ``order`` is unique in a key.
    Lists of values, alphas and names are smoothed in the same passes.

    The weighted sum of the last values is made in three passes, each of a few lagged sums of the pass before, so a pass costs
    the same at every row, and all have one order of rows: a task sorts them once and holds them once. From a missing value
    on the result is null; from one that isn't finite on it is that, or NaN.
    """
    asked = list(zip(*([x] if isinstance(x, (str, float)) else x for x in (value, alpha, out)), strict=True))
    rows = Window.partitionBy(key).orderBy(order)
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for k, (v, a, _) in enumerate(asked):
        x = F.col(v).cast("double")
        made[f"_y{k}"] = F.when(F.row_number().over(rows) == 1, x).otherwise(x * a)
        made[f"_holes{k}"] = F.count_if(x.isNull()).over(so_far)
        made[f"_odd{k}"] = F.sum(F.when(F.abs(x) < float("inf"), 0.0).otherwise(x)).over(so_far)
    df = df.withColumns(made)
    for level in range(3):
        made = {}
        for k, (_, a, _) in enumerate(asked):
            parts = max(2, math.ceil((FADED / -math.log(1 - a)) ** (1 / 3)))
            step = parts**level
            older = ((1 - a) ** (j * step) * F.lag(f"_y{k}", j * step, 0.0).over(rows) for j in range(1, parts))
            made[f"_y{k}"] = sum(older, F.col(f"_y{k}"))
        df = df.withColumns(made)
    y = {o: F.when(F.col(f"_holes{k}") == 0, F.when(F.col(f"_odd{k}") == 0, F.col(f"_y{k}")).otherwise(F.col(f"_odd{k}"))) for k, (_, _, o) in enumerate(asked)}
    return df.withColumns(y).drop(*(f"{c}{k}" for c in ("_y", "_holes", "_odd") for k in range(len(asked))))


def smooth_grouped(df: DataFrame, value: str, alpha: float, out: str, key: str = "symbol", order: str = "d") -> DataFrame:
    """The same smoothing (unseeded) for series of any length: one symbol's rows at a time."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(order, kind="stable")
        batch[out] = batch[value].ewm(alpha=alpha, adjust=False).mean()
        return batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"
    return df.groupBy(key).applyInPandas(run, schema)


def running_drawdown(value: Column, over: WindowSpec | None = None) -> Column:
    return value / F.max(value).over((over or by_day()).rowsBetween(Window.unboundedPreceding, 0)) - 1


def path_drawdown(values: Column) -> Column:
    """Least of x / running maximum - 1 over an array of positive numbers; null for fewer than two."""
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("worst"))
    end = F.aggregate(
        values,
        start,
        lambda s, x: F.struct(
            F.greatest(s["top"], x).alias("top"), F.least(s["worst"], x / F.greatest(s["top"], x) - 1).alias("worst")
        ),
    )
    return F.when(F.size(values) >= 2, end["worst"])


