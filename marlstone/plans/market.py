"""Bars, indicators, window functions and technical rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.series import (
    by_day,
    change,
    cross_up,
    full,
    path_drawdown,
    rolling_mean,
    rolling_means,
    rolling_ratio,
    running_drawdown,
    smoothed,
    smoothed_any,
)
from marlstone.operators.ordering import materialised, ranked
from marlstone.operators.rules import RulePack, compile_pack
from marlstone.registry import query
from marlstone.sources.tables import BARS_SQL, bars, table


# Columns are made by functions: modules are imported before there is a Spark session.


def C() -> Column:
    return F.col("close")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def V() -> Column:
    return F.col("volume")


def day() -> Column:
    return F.date_format("d", "yyyy-MM-dd").alias("d")


def index() -> Column:
    return F.row_number().over(by_day()) - 1



def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def r4(c: Column, name: str) -> Column:
    """To four places, with the boundary off the exact halves that means of prices fall on: sums in another order agree."""
    return (F.floor(c * 1e4 + 0.5003717) / 1e4).alias(name)


def with_bars(body: str) -> str:
    return f"WITH {BARS_SQL} {body}"


def mean_sql(x: str, n: int) -> str:
    """Full-frame rolling mean."""
    w = f"(PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN avg({x}) OVER {w} END"


def ewm_sql(x: str, alpha: str, i: str = "(n - 1)") -> str:
    w = "(PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (
        f"pow(1 - {alpha}, {i}) * (max(CASE WHEN {i} = 0 THEN {x} END) OVER {w}"
        f" + {alpha} * coalesce(sum(CASE WHEN {i} >= 1 THEN {x} * pow(1 - {alpha}, -{i}) END) OVER {w}, 0))"
    )


DAY_SQL = "strftime(d, '%Y-%m-%d') AS d"


@query("ind_ma", with_bars(f"SELECT symbol, {DAY_SQL}, floor(({mean_sql('close', 5)}) * 1e4 + 0.5003717) / 1e4 AS ma5, floor(({mean_sql('close', 20)}) * 1e4 + 0.5003717) / 1e4 AS ma20, floor(({mean_sql('close', 60)}) * 1e4 + 0.5003717) / 1e4 AS ma60 FROM bars"))
def ind_ma(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), r4(rolling_mean(C(), 5), "ma5"), r4(rolling_mean(C(), 20), "ma20"), r4(rolling_mean(C(), 60), "ma60"))


@query("ind_ema", with_bars(f"SELECT symbol, {DAY_SQL}, floor(({ewm_sql('close', '(2.0/13)')}) * 1e4 + 0.5003717) / 1e4 AS ema12, floor(({ewm_sql('close', '(2.0/27)')}) * 1e4 + 0.5003717) / 1e4 AS ema26 FROM bars"))
def ind_ema(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("i", index())
    return b.select("symbol", day(), r4(smoothed(C(), 2 / 13, F.col("i")), "ema12"), r4(smoothed(C(), 2 / 27, F.col("i")), "ema26"))


def macd(b: DataFrame) -> DataFrame:
    """Adds dif, dea and macd."""
    b = b.withColumn("i", index())
    b = b.withColumn("dif", smoothed(C(), 2 / 13, F.col("i")) - smoothed(C(), 2 / 27, F.col("i")))
    b = b.withColumn("dea", smoothed(F.col("dif"), 2 / 10, F.col("i")))
    return b.withColumn("macd", 2 * (F.col("dif") - F.col("dea"))).drop("i")


MACD_SQL = f"""{BARS_SQL}, m1 AS (SELECT *, {ewm_sql('close', '(2.0/13)')} - {ewm_sql('close', '(2.0/27)')} AS dif FROM bars),
m2 AS (SELECT *, {ewm_sql('dif', '0.2')} AS dea FROM m1), m AS (SELECT *, 2 * (dif - dea) AS macd FROM m2)"""


@query("ind_macd", f"WITH {MACD_SQL} SELECT symbol, {DAY_SQL}, floor((dif) * 1e4 + 0.5003717) / 1e4 AS dif, floor((dea) * 1e4 + 0.5003717) / 1e4 AS dea, floor((macd) * 1e4 + 0.5003717) / 1e4 AS macd FROM m")
def ind_macd(spark: SparkSession, sf: str) -> DataFrame:
    return macd(bars(spark, sf)).select("symbol", day(), r4(F.col("dif"), "dif"), r4(F.col("dea"), "dea"), r4(F.col("macd"), "macd"))


def kdj(b: DataFrame, n: int = 9, m: int = 3) -> DataFrame:
    """Adds rsv, k, d_line and j; k and d_line begin at 50 before the first full window."""
    top, bottom = full(H(), n, F.max), full(L(), n, F.min)
    b = b.withColumn("rsv", F.when(top == bottom, F.lit(50.0)).otherwise((C() - bottom) / (top - bottom) * 100))
    b = b.withColumn("i", index() - (n - 1))
    b = b.withColumn("k", smoothed(F.col("rsv"), 1 / m, F.col("i"), F.lit(50.0)))
    b = b.withColumn("d_line", smoothed(F.col("k"), 1 / m, F.col("i"), F.lit(50.0)))
    return b.withColumn("j", 3 * F.col("k") - 2 * F.col("d_line")).drop("i")


def seeded_sql(x: str) -> str:
    w = "(PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN n >= 9 THEN pow(2.0/3, n - 9) * (50 * (2.0/3) + (1.0/3) * coalesce(sum(CASE WHEN n >= 9 THEN {x} * pow(2.0/3, -(n - 9)) END) OVER {w}, 0)) END"


_W9 = "(PARTITION BY symbol ORDER BY d ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"
KDJ_SQL = f"""{BARS_SQL}, k0 AS (SELECT *, max(high) OVER {_W9} AS top, min(low) OVER {_W9} AS bottom FROM bars),
k1 AS (SELECT *, CASE WHEN n < 9 THEN NULL WHEN top = bottom THEN 50.0 ELSE (close - bottom) / (top - bottom) * 100 END AS rsv FROM k0),
k2 AS (SELECT *, {seeded_sql('rsv')} AS k FROM k1), k3 AS (SELECT *, {seeded_sql('k')} AS d_line FROM k2)"""


@query("ind_kdj", f"WITH {KDJ_SQL} SELECT symbol, {DAY_SQL}, round(rsv, 6) AS rsv, round(k, 6) AS k, round(d_line, 6) AS d_line, round(3 * k - 2 * d_line, 6) AS j FROM k3")
def ind_kdj(spark: SparkSession, sf: str) -> DataFrame:
    return kdj(bars(spark, sf)).select("symbol", day(), *(r6(F.col(x), x) for x in ("rsv", "k", "d_line", "j")))


@query("ind_stl", f"WITH {BARS_SQL}, a AS (SELECT *, {ewm_sql('close', '(2.0/11)')} AS e FROM bars) SELECT symbol, {DAY_SQL}, floor(({ewm_sql('e', '(2.0/11)')}) * 1e4 + 0.5003717) / 1e4 AS stl FROM a")
def ind_stl(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("i", index()).withColumn("e", smoothed(C(), 2 / 11, F.col("i")))
    return b.select("symbol", day(), r4(smoothed(F.col("e"), 2 / 11, F.col("i")), "stl"))


#: Windows of the long line.
LONG = (14, 28, 57, 114)


def long_line() -> Column:
    a, b, c, d = (rolling_mean(C(), n) for n in LONG)
    return (a + b + c + d) / 4


LTL_SQL = "(" + " + ".join(f"({mean_sql('close', n)})" for n in (14, 28, 57, 114)) + ") / 4"


@query("ind_ltl", with_bars(f"SELECT symbol, {DAY_SQL}, floor(({LTL_SQL}) * 1e4 + 0.5003717) / 1e4 AS ltl FROM bars"))
def ind_ltl(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), r4(long_line(), "ltl"))


@query("ind_rolling_ratio", with_bars(f"SELECT symbol, {DAY_SQL}, round(volume / nullif({mean_sql('volume', 20)}, 0), 6) AS volume_ratio20 FROM bars"))
def ind_rolling_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), r6(rolling_ratio(V(), 20), "volume_ratio20"))


def stl_kdj(b: DataFrame, n: int = 9, m: int = 3) -> DataFrame:
    """Adds stl, kdj_k, kdj_d and kdj_j, of series of any length; the three are null before the first full window of ``n``."""
    frame = by_day().rowsBetween(-(n - 1), 0)
    top, bottom, ready = F.max(H()).over(frame), F.min(L()).over(frame), index() >= n - 1
    rsv = F.when(top == bottom, F.lit(50.0)).otherwise((C() - bottom) / (top - bottom) * 100)
    # A missing value adds nothing, as in ``smoothed``. Smoothing values of 50 gives 50, the seed of the first full window.
    b = b.withColumns({"_c": F.when(index() == 0, C()).otherwise(F.coalesce(C(), F.lit(0.0))), "_rsv": F.when(ready, F.coalesce(rsv, F.lit(0.0))).otherwise(50.0)})
    b = smoothed_any(b, ["_c", "_rsv"], [2 / 11, 1 / m], ["_e", "_k"])
    b = smoothed_any(b, ["_e", "_k"], [2 / 11, 1 / m], ["stl", "_d"])
    k, d = (F.when(ready, F.col(x)) for x in ("_k", "_d"))
    return b.withColumns({"kdj_k": k, "kdj_d": d, "kdj_j": 3 * k - 2 * d}).drop("_c", "_rsv", "_e", "_k", "_d")


ALL_SQL = f"""{MACD_SQL}, a AS (SELECT *, {ewm_sql('close', '(2.0/11)')} AS e, max(high) OVER {_W9} AS top, min(low) OVER {_W9} AS bottom FROM m),
k1 AS (SELECT *, CASE WHEN n < 9 THEN NULL WHEN top = bottom THEN 50.0 ELSE (close - bottom) / (top - bottom) * 100 END AS rsv FROM a),
k2 AS (SELECT *, {seeded_sql('rsv')} AS k FROM k1), k3 AS (SELECT *, {seeded_sql('k')} AS d_line FROM k2)"""


@query(
    "ind_calc_all",
    f"WITH {ALL_SQL} SELECT symbol, {DAY_SQL}, "
    + ", ".join(f"floor(({mean_sql('close', n)}) * 1e4 + 0.5003717) / 1e4 AS ma{n}" for n in (5, 10, 20, 60, 120, 240))
    + f", floor(({mean_sql('volume', 5)}) * 1e4 + 0.5003717) / 1e4 AS volume_ma5, floor(({mean_sql('volume', 10)}) * 1e4 + 0.5003717) / 1e4 AS volume_ma10, round(volume / nullif({mean_sql('volume', 20)}, 0), 6) AS volume_ratio20,"
    f" floor(({LTL_SQL}) * 1e4 + 0.5003717) / 1e4 AS ltl, floor((dif) * 1e4 + 0.5003717) / 1e4 AS dif, floor((dea) * 1e4 + 0.5003717) / 1e4 AS dea, floor((macd) * 1e4 + 0.5003717) / 1e4 AS macd,"
    f" floor(({ewm_sql('e', '(2.0/11)')}) * 1e4 + 0.5003717) / 1e4 AS stl, floor((k) * 1e4 + 0.5003717) / 1e4 AS kdj_k, floor((d_line) * 1e4 + 0.5003717) / 1e4 AS kdj_d, floor((3 * k - 2 * d_line) * 1e4 + 0.5003717) / 1e4 AS kdj_j FROM k3",
)
def ind_calc_all(spark: SparkSession, sf: str) -> DataFrame:
    """All 17 series of the reference's ``calc_all``."""
    b = rolling_means(bars(spark, sf), "close", [5, 10, 20, 60, 120, 240, *LONG], "ma")
    b = stl_kdj(macd(rolling_means(b, "volume", [5, 10, 20], "volume_ma")))
    return b.select(
        "symbol",
        day(),
        *(r4(F.col(x), x) for x in ("ma5", "ma10", "ma20", "ma60", "ma120", "ma240", "volume_ma5", "volume_ma10")),
        r6(V() / F.nullif("volume_ma20", F.lit(0.0)), "volume_ratio20"),
        r4(sum((F.col(f"ma{n}") for n in LONG[1:]), F.col(f"ma{LONG[0]}")) / 4, "ltl"),
        *(r4(F.col(x), x) for x in ("dif", "dea", "macd", "stl", "kdj_k", "kdj_d", "kdj_j")),
    )


_R1 = "close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) - 1"


@query("ind_return", with_bars(f"SELECT symbol, {DAY_SQL}, round({_R1}, 6) AS ret FROM bars"))
def ind_return(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), r6(change(C()), "ret"))


@query("ind_period_return", with_bars("SELECT symbol, round(close / lag(close, 5) OVER s - 1, 6) AS r5, round(close / lag(close, 20) OVER s - 1, 6) AS r20, round(close / lag(close, 120) OVER s - 1, 6) AS r120 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1"))
def ind_period_return(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("symbol", "d", *(r6(change(C(), n), f"r{n}") for n in (5, 20, 120)))
    return latest(b).drop("d")


def latest(b: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    others = [c for c in b.columns if c not in ("symbol", "d")]
    return b.groupBy("symbol").agg(F.max("d").alias("d"), F.max_by(F.struct(*others), "d").alias("x")).select("symbol", "d", "x.*")


@query("ind_volatility", with_bars(f", q AS (SELECT *, {_R1} AS r FROM bars) SELECT symbol, {DAY_SQL}, round(CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * 100 END, 6) AS volatility FROM q WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def ind_volatility(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("r", change(C()))
    return b.select("symbol", day(), r6(full(F.col("r"), 20, F.stddev_samp) * 100, "volatility"))


@query("ind_max_drawdown", with_bars(", q AS (SELECT symbol, d, close, n, max(n) OVER (PARTITION BY symbol) AS last FROM bars), p AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS dd FROM q WHERE n > last - 21) SELECT symbol, round(least(min(dd), 0) * 100, 6) AS max_drawdown FROM p GROUP BY symbol"))
def ind_max_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    w = by_day().rowsBetween(-20, 0)
    b = bars(spark, sf).select("symbol", "d", F.collect_list(C()).over(w).alias("path"))
    return latest(b).select("symbol", r6(path_drawdown(F.col("path")) * 100, "max_drawdown"))


@query("ind_last_vs_peak", with_bars(f"SELECT symbol, {DAY_SQL}, round(close / max(close) OVER w - 1, 6) AS vs_peak FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def ind_last_vs_peak(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), r6(C() / F.max(C()).over(by_day().rowsBetween(-19, 0)) - 1, "vs_peak"))


@query("ind_amount_pctile", with_bars(", q AS (SELECT *, max(n) OVER (PARTITION BY symbol) AS last FROM bars), p AS (SELECT symbol, amount, last_value(amount) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM q WHERE n > last - 120) SELECT symbol, round(CASE WHEN count(*) >= 30 THEN 100.0 * count(*) FILTER (amount <= now) / count(*) END, 6) AS pctile FROM p GROUP BY symbol"))
def ind_amount_pctile(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("symbol", "d", "amount", F.collect_list("amount").over(by_day().rowsBetween(-119, 0)).alias("seen"))
    share = F.size(F.filter("seen", lambda x: x <= F.col("amount"))) * 100.0 / F.size("seen")
    return latest(b).select("symbol", r6(F.when(F.size("seen") >= 30, share), "pctile"))


FEATURES_SQL = f"""{BARS_SQL}, f0 AS (SELECT *, {_R1} AS r FROM bars),
f1 AS (SELECT symbol, d, n, close, close / lag(close, 1) OVER s - 1 AS r1, close / lag(close, 5) OVER s - 1 AS r5, close / lag(close, 20) OVER s - 1 AS r20,
  close > {mean_sql('close', 20)} AS above_ma20, close > {mean_sql('close', 60)} AS above_ma60,
  close >= max(high) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS new_high,
  CASE WHEN count(r) OVER v = 20 THEN stddev_samp(r) OVER v * 100 END AS volatility, amount,
  amount / nullif({mean_sql('amount', 20)}, 0) AS amount_ratio
  FROM f0 WINDOW s AS (PARTITION BY symbol ORDER BY d), v AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
feat AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1)"""


def stock_features(b: DataFrame) -> DataFrame:
    """The latest row of each symbol with its returns, position against averages, volatility and turnover."""
    return latest(feature_rows(b))


def feature_rows(b: DataFrame) -> DataFrame:
    """Every row with what ``stock_features`` has of the latest."""
    b = b.withColumn("r", change(C()))
    return b.select(
        "symbol",
        "d",
        F.row_number().over(by_day()).alias("n"),
        "close",
        *(change(C(), k).alias(f"r{k}") for k in (1, 5, 20)),
        (C() > rolling_mean(C(), 20)).alias("above_ma20"),
        (C() > rolling_mean(C(), 60)).alias("above_ma60"),
        (C() >= F.max(H()).over(by_day().rowsBetween(-19, 0))).alias("new_high"),
        (full(F.col("r"), 20, F.stddev_samp) * 100).alias("volatility"),
        "amount",
        rolling_ratio(F.col("amount"), 20).alias("amount_ratio"),
    )


@query("ind_stock_features", f"WITH {FEATURES_SQL} SELECT symbol, {DAY_SQL}, CAST(n AS BIGINT) AS n, close, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r20, 6) AS r20, above_ma20, above_ma60, new_high, round(volatility, 6) AS volatility, round(amount_ratio, 6) AS amount_ratio FROM feat")
def ind_stock_features(spark: SparkSession, sf: str) -> DataFrame:
    return stock_features(bars(spark, sf)).select(
        "symbol", day(), F.col("n").cast("long").alias("n"), "close", *(r6(F.col(x), x) for x in ("r1", "r5", "r20")), "above_ma20", "above_ma60", "new_high",
        r6(F.col("volatility"), "volatility"), r6(F.col("amount_ratio"), "amount_ratio"),
    )


# ---- registry forms of the indicators

_W20 = "(PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("reg_rolling_std", with_bars(f", q AS (SELECT *, {_R1} AS r FROM bars) SELECT symbol, {DAY_SQL}, round(CASE WHEN count(r) OVER {_W20} = 20 THEN stddev_samp(r) OVER {_W20} END, 8) AS rolling_std, floor(({mean_sql('close', 20)}) * 1e4 + 0.5003717) / 1e4 AS sma, floor(({mean_sql('volume', 20)}) * 1e4 + 0.5003717) / 1e4 AS volume_ma FROM q"))
def reg_rolling_std(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("r", change(C()))
    return b.select("symbol", day(), F.round(full(F.col("r"), 20, F.stddev_samp), 8).alias("rolling_std"), r4(rolling_mean(C(), 20), "sma"), r4(rolling_mean(V(), 20), "volume_ma"))


# ---- windows


@query("wf_rolling", with_bars(f"SELECT symbol, {DAY_SQL}, CASE WHEN n >= 20 THEN max(high) OVER {_W20} END AS top, CASE WHEN n >= 20 THEN min(low) OVER {_W20} END AS bottom, floor(({mean_sql('close', 20)}) * 1e4 + 0.5003717) / 1e4 AS mean FROM bars"))
def wf_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), full(H(), 20, F.max).alias("top"), full(L(), 20, F.min).alias("bottom"), r4(rolling_mean(C(), 20), "mean"))


@query("wf_lag", with_bars(f"SELECT symbol, {DAY_SQL}, lag(close) OVER s AS before, lag(close, 5) OVER s AS before5 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)"))
def wf_lag(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("symbol", day(), F.lag(C()).over(by_day()).alias("before"), F.lag(C(), 5).over(by_day()).alias("before5"))


@query("wf_cross_up", with_bars(f", q AS (SELECT symbol, d, {mean_sql('close', 5)} AS a, {mean_sql('close', 10)} AS b FROM bars) SELECT symbol, {DAY_SQL}, coalesce(lag(a) OVER s <= lag(b) OVER s AND a > b, false) AS crossed FROM q WINDOW s AS (PARTITION BY symbol ORDER BY d)"))
def wf_cross_up(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("symbol", "d", rolling_mean(C(), 5).alias("a"), rolling_mean(C(), 10).alias("b"))
    return b.select("symbol", day(), cross_up(F.col("a"), F.col("b")).alias("crossed"))


@query("wf_running_max", with_bars(f"SELECT symbol, {DAY_SQL}, max(close) OVER s AS top, min(close) OVER s AS bottom, round(close / max(close) OVER s - 1, 6) AS drawdown FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def wf_running_max(spark: SparkSession, sf: str) -> DataFrame:
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return bars(spark, sf).select("symbol", day(), F.max(C()).over(w).alias("top"), F.min(C()).over(w).alias("bottom"), r6(running_drawdown(C()), "drawdown"))


@query("wf_new_high", with_bars(f"SELECT symbol, {DAY_SQL}, close >= max(high) OVER {_W20} AS new_high, coalesce(close >= max(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS breakout FROM bars"))
def wf_new_high(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select(
        "symbol", day(), (C() >= F.max(H()).over(by_day().rowsBetween(-19, 0))).alias("new_high"), F.coalesce(C() >= F.max(C()).over(by_day().rowsBetween(-20, -1)), F.lit(False)).alias("breakout")
    )


@query("wf_count_below", with_bars(f", q AS (SELECT symbol, d, close < {mean_sql('close', 20)} AS below FROM bars) SELECT symbol, {DAY_SQL}, CAST(coalesce(sum(CASE WHEN below THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS n_below FROM q"))
def wf_count_below(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("symbol", "d", (C() < rolling_mean(C(), 20)).alias("below"))
    return b.select("symbol", day(), F.sum(F.when(F.col("below"), 1).otherwise(0)).over(by_day().rowsBetween(-9, 0)).alias("n_below"))


CROSS_SQL = f"""{FEATURES_SQL}, x AS (SELECT symbol, r20 FROM feat WHERE r20 IS NOT NULL)"""


def cross_section(spark: SparkSession, sf: str) -> DataFrame:
    """One row per symbol: its latest 20-day return."""
    x = latest(bars(spark, sf).select("symbol", "d", change(C(), 20).alias("r20")))
    return x.where("r20 IS NOT NULL").select("symbol", "r20", F.lit(0).alias("day"))


def tied_ranks(x: DataFrame) -> DataFrame:
    """``x`` (symbol, v) with the ranks that equal values take from (``least``) and to (``most``), and the number of rows ``n``.
    Ranks run over range partitions; equal values are counted before they are met again."""
    r = ranked(x, F.col("v"), F.col("symbol"))
    ties = r.groupBy("v").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    return r.drop("rank").join(ties, "v").join(F.broadcast(r.agg(F.count("*").alias("n"))))  # one row


@query("wf_rps", f"WITH {CROSS_SQL} SELECT symbol, round(cume_dist() OVER (ORDER BY r20) * 100, 2) AS rps FROM x")
def wf_rps(spark: SparkSession, sf: str) -> DataFrame:
    x = tied_ranks(cross_section(spark, sf).select("symbol", F.col("r20").alias("v")))
    return x.select("symbol", F.round(F.col("most") / F.col("n") * 100, 2).alias("rps"))


@query("wf_percentile_avg", f"WITH {CROSS_SQL}, y AS (SELECT symbol, round(r20, 1) AS v FROM x) SELECT symbol, round(CASE WHEN count(*) OVER () = 1 THEN 100.0 ELSE (rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (count(*) OVER () - 1) * 100 END, 6) AS pctile FROM y")
def wf_percentile_avg(spark: SparkSession, sf: str) -> DataFrame:
    x = cross_section(spark, sf).select("symbol", F.round("r20", 1).alias("v"))
    between = (F.col("least") + F.col("most")) / 2 - 1
    return tied_ranks(x).select("symbol", r6(F.when(F.col("n") == 1, 100.0).otherwise(between / (F.col("n") - 1) * 100), "pctile"))


def average_percentile(v: Column, by: list[str]) -> Column:
    """Percentile rank with the average rank of ties; 100 for a single value, null for nulls."""
    all_rows, ties = Window.partitionBy(*by), Window.partitionBy(*by, v)
    n = F.count(v).over(all_rows)
    rank = F.rank().over(all_rows.orderBy(v.asc_nulls_last()))
    return F.when(v.isNotNull(), F.when(n == 1, 100.0).otherwise((rank - 1 + (F.count(v).over(ties) - 1) / 2) / (n - 1) * 100))


@query("ag_winsorize", f"WITH {CROSS_SQL} SELECT symbol, round(least(greatest(r20, (SELECT quantile_cont(r20, 0.01) FROM x)), (SELECT quantile_cont(r20, 0.99) FROM x)), 6) AS clipped FROM x")
def ag_winsorize(spark: SparkSession, sf: str) -> DataFrame:
    x = cross_section(spark, sf)
    q = x.groupBy("day").agg(F.percentile("r20", 0.01).alias("lo"), F.percentile("r20", 0.99).alias("hi"))
    return x.join(F.broadcast(q), "day").select("symbol", r6(F.least(F.greatest("r20", "lo"), "hi"), "clipped"))


@query("ag_robust_z", f"WITH {CROSS_SQL}, m AS (SELECT median(r20) AS c FROM x), s AS (SELECT median(abs(r20 - c)) AS mad FROM x, m) SELECT symbol, round(CASE WHEN mad = 0 THEN 0.0 ELSE (r20 - c) / (1.4826 * mad) END, 6) AS z FROM x, m, s")
def ag_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    x = materialised(cross_section(spark, sf))  # a row a symbol, read three times
    c = x.join(F.broadcast(x.groupBy("day").agg(F.median("r20").alias("c"))), "day")
    mad = c.groupBy("day").agg(F.median(F.abs(F.col("r20") - F.col("c"))).alias("mad"))
    z = F.when(F.col("mad") == 0, 0.0).otherwise((F.col("r20") - F.col("c")) / (1.4826 * F.col("mad")))
    return c.join(F.broadcast(mad), "day").select("symbol", r6(z, "z"))


@query("wf_ffill", with_bars(", days AS (SELECT DISTINCT d FROM bars), sy AS (SELECT DISTINCT symbol FROM bars), g AS (SELECT symbol, days.d, close FROM sy CROSS JOIN days LEFT JOIN bars USING (symbol, d)) SELECT symbol, strftime(d, '%Y-%m-%d') AS d, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM g"))
def wf_ffill(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    symbols = bars(spark, sf).select("symbol").distinct()
    # A calendar has one row per trading day: broadcast against the symbols it is filled for.
    grid = symbols.join(F.broadcast(b.select("d").distinct()), how="cross").join(b.select("symbol", "d", "close"), ["symbol", "d"], "left")
    return grid.select("symbol", day(), F.last("close", ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0)).alias("close"))


# ---- signals and rules


@query("sig_triple_cross", f"WITH {MACD_SQL}, q AS (SELECT symbol, d, {mean_sql('close', 5)} AS a, {mean_sql('close', 10)} AS b, dif, dea, {mean_sql('volume', 5)} AS va, {mean_sql('volume', 10)} AS vb FROM m), c AS (SELECT symbol, d, CAST(coalesce(lag(a) OVER s <= lag(b) OVER s AND a > b, false) AS INT) AS x1, CAST(coalesce(lag(dif) OVER s <= lag(dea) OVER s AND dif > dea, false) AS INT) AS x2, CAST(coalesce(lag(va) OVER s <= lag(vb) OVER s AND va > vb, false) AS INT) AS x3 FROM q WINDOW s AS (PARTITION BY symbol ORDER BY d)) SELECT symbol, {DAY_SQL}, CAST(30 * (x1 + x2 + x3) AS BIGINT) AS score, x1 + x2 + x3 = 3 AS fires FROM c WHERE x1 + x2 + x3 > 0")
def sig_triple_cross(spark: SparkSession, sf: str) -> DataFrame:
    b = macd(bars(spark, sf)).select(
        "symbol", "d", rolling_mean(C(), 5).alias("a"), rolling_mean(C(), 10).alias("b"), "dif", "dea", rolling_mean(V(), 5).alias("va"), rolling_mean(V(), 10).alias("vb")
    )
    n = sum((cross_up(F.col(x), F.col(y)).cast("int") for x, y in (("a", "b"), ("dif", "dea"), ("va", "vb"))), F.lit(0))
    return b.withColumn("n", n).where("n > 0").select("symbol", day(), (F.col("n") * 30).cast("long").alias("score"), (F.col("n") == 3).alias("fires"))


@query("sig_b2", with_bars(f", q AS (SELECT symbol, d, n, close / lag(close) OVER s - 1 AS gain, max(high) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior, close, volume / nullif({mean_sql('volume', 20)}, 0) AS vr, {mean_sql('close', 20)} AS ma20, min(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS low60 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)), z AS (SELECT symbol, d, CASE WHEN gain >= 0.04 THEN 25 ELSE 0 END + CASE WHEN close >= prior THEN 25 ELSE 0 END + CASE WHEN vr >= 1.35 THEN 20 ELSE 0 END + CASE WHEN close > ma20 THEN 10 ELSE 0 END - CASE WHEN close / low60 > 1.8 THEN 15 ELSE 0 END AS score FROM q WHERE n > 60) SELECT symbol, {DAY_SQL}, CAST(greatest(score, 0) AS BIGINT) AS score, score >= 75 AS fires FROM z WHERE score >= 40"))
def sig_b2(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select(
        "symbol", "d", F.row_number().over(by_day()).alias("n"), change(C()).alias("gain"), F.max(H()).over(by_day().rowsBetween(-20, -1)).alias("prior"), "close",
        rolling_ratio(V(), 20).alias("vr"), rolling_mean(C(), 20).alias("ma20"), F.min(C()).over(by_day().rowsBetween(-59, 0)).alias("low60"),
    )
    parts = [(F.col("gain") >= 0.04, 25), (C() >= F.col("prior"), 25), (F.col("vr") >= 1.35, 20), (C() > F.col("ma20"), 10), (C() / F.col("low60") > 1.8, -15)]
    score = sum((F.when(p, k).otherwise(0) for p, k in parts), F.lit(0))
    b = b.where("n > 60").withColumn("score", score).where("score >= 40")
    return b.select("symbol", day(), F.greatest("score", F.lit(0)).cast("long").alias("score"), (F.col("score") >= 75).alias("fires"))


#: A pack of two rules on the latest bar, and one with an operator that only compares with context.
CORE = RulePack(
    "core",
    {
        "trend": ({"all": [{"gt": ["close", "ma20"]}, {"gt": ["ma20", "ma60"]}]}, 25),
        "macd_cross": ({"cross_up": ["dif", "dea"]}, 15),
        "active": ({"any": [{"gte": ["volume_ratio20", 1.5]}, {"lt": ["close", "ma5"]}]}, 10),
        "market": ({"context_gte": ["market.breadth", 0.5]}, 5),
    },
)


def indicator_frame(spark: SparkSession, sf: str) -> DataFrame:
    b = macd(bars(spark, sf))
    return b.withColumns({"ma5": rolling_mean(C(), 5), "ma20": rolling_mean(C(), 20), "ma60": rolling_mean(C(), 60), "volume_ratio20": rolling_ratio(V(), 20)})


RULES_SQL = f"""{MACD_SQL}, q AS (SELECT *, {mean_sql('close', 5)} AS ma5, {mean_sql('close', 20)} AS ma20, {mean_sql('close', 60)} AS ma60, volume / nullif({mean_sql('volume', 20)}, 0) AS vr FROM m),
e AS (SELECT symbol, d, n, close > ma20 AND ma20 > ma60 AS trend, coalesce(lag(dif) OVER s <= lag(dea) OVER s AND dif > dea, false) AS macd_cross, vr >= 1.5 OR close < ma5 AS active, true AS market FROM q WINDOW s AS (PARTITION BY symbol ORDER BY d))"""


@query("rule_eval", f"WITH {RULES_SQL} SELECT symbol, {DAY_SQL}, CASE trend WHEN true THEN 'TRUE' WHEN false THEN 'FALSE' ELSE 'INDETERMINATE' END AS trend, CASE macd_cross WHEN true THEN 'TRUE' WHEN false THEN 'FALSE' ELSE 'INDETERMINATE' END AS macd_cross, CASE active WHEN true THEN 'TRUE' WHEN false THEN 'FALSE' ELSE 'INDETERMINATE' END AS active, CASE market WHEN true THEN 'TRUE' WHEN false THEN 'FALSE' ELSE 'INDETERMINATE' END AS market FROM e")
def rule_eval(spark: SparkSession, sf: str) -> DataFrame:
    rules = compile_pack(CORE, {"market": {"breadth": 0.6}})
    named = {k: F.when(c, "TRUE").when(~c, "FALSE").otherwise("INDETERMINATE") for k, (c, _) in rules.items()}
    return indicator_frame(spark, sf).withColumns({f"_{k}": c for k, c in named.items()}).select("symbol", day(), *(F.col(f"_{k}").alias(k) for k in named))


@query("rule_scan", f"WITH {RULES_SQL} SELECT symbol, {DAY_SQL}, CAST(CASE WHEN trend THEN 25 ELSE 0 END + CASE WHEN macd_cross THEN 15 ELSE 0 END + CASE WHEN active THEN 10 ELSE 0 END + CASE WHEN market THEN 5 ELSE 0 END AS BIGINT) AS score FROM e WHERE n >= 260 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1")
def rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Score of the latest bar of each symbol that has the profile's 260 bars."""
    rules = compile_pack(CORE, {"market": {"breadth": 0.6}})
    score = sum((F.when(c, k).otherwise(0) for c, k in rules.values()), F.lit(0)).cast("long")
    b = indicator_frame(spark, sf).select("symbol", "d", F.row_number().over(by_day()).alias("n"), score.alias("score"))
    return latest(b).where("n >= 260").select("symbol", day(), "score")


@query("scan_kline", with_bars(f"SELECT symbol, {DAY_SQL}, open, high, low, close, volume, amount FROM bars WHERE symbol IN (1, 2, 3) AND d >= DATE '1997-01-01' AND d <= DATE '1997-12-31'"))
def scan_kline(spark: SparkSession, sf: str) -> DataFrame:
    # Bars need the day before the range for their first open, so the range applies to the finished bars.
    b = bars(spark, sf).where(F.col("symbol").isin(1, 2, 3) & F.col("d").between("1997-01-01", "1997-12-31"))
    return b.select("symbol", day(), "open", "high", "low", "close", "volume", "amount")


@query("scan_quotes", with_bars("SELECT symbol, close AS last_price, open AS last_close, amount FROM bars WHERE d <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1"))
def scan_quotes(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).where(F.col("d") <= "1999-06-30").select("symbol", "d", C().alias("last_price"), F.col("open").alias("last_close"), "amount")
    return latest(b).drop("d")


@query("tk_amount10", with_bars("SELECT strftime(d, '%Y-%m-%d') AS d, symbol, amount FROM bars QUALIFY row_number() OVER (PARTITION BY d ORDER BY amount DESC, symbol) <= 10"))
def tk_amount10(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    w = Window.partitionBy("d").orderBy(F.desc("amount"), "symbol")
    return b.withColumn("k", F.row_number().over(w)).where("k <= 10").select(day(), "symbol", "amount")


@query("tk_latest", with_bars("SELECT symbol, strftime(max(d), '%Y-%m-%d') AS d, max_by(close, d) AS close FROM bars GROUP BY symbol"))
def tk_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(bars(spark, sf).select("symbol", "d", "close")).select("symbol", day(), "close")


@query("scan_industry_map", "SELECT s_suppkey AS symbol, n_name AS industry, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def scan_industry_map(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    own = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return own.select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"), F.col("r_name").alias("region"))
