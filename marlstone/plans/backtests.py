"""Backtests, their metrics and statistics, and the regime machine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import prices as X
from marlstone.functions import scores as S
from marlstone.functions.series import change, quotient
from marlstone.operators.backtest import prepared, run_top_k, within_reach
from marlstone.operators.ordering import materialised, ranked, running_max_before
from marlstone.operators.regimes import confirm
from marlstone.plans.joins import text_day
from marlstone.plans.scores import ARGMAX_SQL, REGIME_SQL, inputs, scored_days
from marlstone.plans.sectors import snap, snap_any, snap_sql
from marlstone.registry import query
from marlstone.sources.tables import BARS_SQL, bars, table

C = F.col

#: strategy: (holdings, days between rebalances)
STRATEGIES = {1: (5, 5), 2: (10, 5), 3: (5, 20), 4: (20, 10)}


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with what a backtest needs: the score is the 20-day return up to the bar before, the price the day's open."""
    b = bars(spark, sf)
    w = Window.partitionBy("symbol").orderBy("d")
    b = b.withColumn("r", change(C("close"), 20)).select("symbol", "d", C("open").alias("price"), "close", "volume", F.lag("r").over(w).alias("score"))
    days = b.select("d").distinct()
    days = days.withColumn("day", F.row_number().over(Window.orderBy("d")) - 1)  # a row a trading day
    return b.join(F.broadcast(days), "d").select("symbol", "d", "day", "price", "close", "volume", "score")


def equity(spark: SparkSession, sf: str) -> DataFrame:
    return run_top_k(within_reach(prepared(panel(spark, sf), F.lit(0.10)), STRATEGIES))


@query("fd_topk_backtest")
def fd_topk_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """A fold that SQL cannot express; the tests hold it against a plain loop."""
    return equity(spark, sf).select("strategy", text_day("d"), F.round("equity", 4).alias("equity"), F.round("turnover", 6).alias("turnover"), "holdings")


@query("fd_event_chain")
def fd_event_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Signal, order and fill of every trade: the signal is made at the close of the trading day before, the fill at the open;
    a fill that isn't after its signal stops the job."""
    e = equity(spark, sf).withColumn("before", F.lag("d").over(Window.partitionBy("strategy").orderBy("d")))
    return event_chain(e.select("strategy", "d", "before", F.posexplode("trades").alias("k", "t")).select("strategy", "d", "before", "k", "t.*"))


def event_chain(trades: DataFrame) -> DataFrame:
    """Times of ``trades`` (strategy, d, before, k, symbol, side, shares); ``before`` is the day whose close gave the signal."""
    at = lambda day, hour, minute: F.make_timestamp_ltz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(minute), F.lit(0))
    signal, fill = at("before", 15, 0), at("d", 9, 30)
    checked = F.when(fill > signal, fill).otherwise(F.raise_error(F.lit("a fill is not after its signal")).cast("timestamp"))
    return trades.select(
        "strategy", text_day("d"), "k", "symbol", "side", F.round("shares", 4).alias("shares"), F.date_format(signal, "yyyy-MM-dd HH:mm").alias("signalled"), F.date_format(checked, "yyyy-MM-dd HH:mm").alias("filled")
    )


@query("ag_fifo_winrate")
def ag_fifo_winrate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of sells that earn more than their lots cost, first bought first sold, costs included.

    Bought and sold quantities of a symbol are intervals on one line of shares; a sell's lots are those its interval meets.
    """
    t = equity(spark, sf).select("strategy", "d", F.posexplode("trades").alias("k", "t")).select("strategy", "d", "k", "t.*")
    w = Window.partitionBy("strategy", "symbol", "side").orderBy("d", "k")
    t = t.withColumn("hi", F.sum("shares").over(w)).withColumn("lo", C("hi") - C("shares"))
    key = F.struct("d", "k")
    b = t.where("side = 'buy'").select("strategy", "symbol", C("lo").alias("bl"), C("hi").alias("bh"), ((C("value") + C("cost")) / C("shares")).alias("unit"))
    s = t.where("side = 'sell'").select("strategy", "symbol", C("lo").alias("sl"), C("hi").alias("sh"), "shares", "value", "cost", key.alias("sale"))
    # Every sell meets few lots: equal keys first, then overlapping intervals.
    m = s.join(b, ["strategy", "symbol"]).where((C("bl") < C("sh")) & (C("bh") > C("sl")))
    take = F.least("bh", "sh") - F.greatest("bl", "sl")
    p = m.groupBy("strategy", "symbol", "sale").agg(F.sum(take).alias("sold"), F.sum(take * C("unit")).alias("paid"), F.max("shares").alias("shares"), F.max("value").alias("value"), F.max("cost").alias("cost"))
    wins = (C("value") * C("sold") / C("shares") - C("cost") - C("paid") > 0).cast("double")
    return p.groupBy("strategy").agg(F.count("*").alias("closed"), F.round(F.avg(wins), 4).alias("win_rate"))


@query("fd_exec_price", f"WITH {BARS_SQL}, n AS (SELECT symbol, d, lead(open) OVER s AS no, lead(close) OVER s AS nc, lead(high) OVER s AS nh, lead(low) OVER s AS nl, lead(amount) OVER s AS na, lead(volume) OVER s AS nv, close * 1.01 AS lim, (symbol + day(d)) % 4 AS m FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)) SELECT symbol, strftime(d, '%Y-%m-%d') AS d, CASE m WHEN 0 THEN 'NEXT_OPEN' WHEN 1 THEN 'NEXT_CLOSE' WHEN 2 THEN 'VWAP' ELSE 'LIMIT_PRICE' END AS model, {snap_sql('CASE m WHEN 0 THEN no WHEN 1 THEN nc WHEN 2 THEN CASE WHEN nv > 0 AND na > 0 THEN na / nv ELSE (nh + nl + nc) / 3 END ELSE CASE WHEN lim BETWEEN nl AND nh THEN lim END END', 4)} AS price FROM n")
def fd_exec_price(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("d")
    ahead = lambda c: F.lead(c).over(w)
    m = (C("symbol") + F.dayofmonth("d")) % 4
    model = F.when(m == 0, "NEXT_OPEN").when(m == 1, "NEXT_CLOSE").when(m == 2, "VWAP").otherwise("LIMIT_PRICE")
    b = bars(spark, sf).select("symbol", "d", model.alias("model"), ahead("open").alias("no"), ahead("close").alias("nc"), ahead("high").alias("nh"), ahead("low").alias("nl"), ahead("amount").alias("na"), ahead("volume").alias("nv"), (C("close") * 1.01).alias("lim"))
    price = X.execution_price(C("model"), C("no"), C("nc"), C("nh"), C("nl"), C("na"), C("nv"), C("lim"))
    return b.select("symbol", text_day("d"), "model", snap(price, 4).alias("price"))


BENCH_SQL = f"{BARS_SQL}, br AS (SELECT d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), bd AS (SELECT d, coalesce(avg(r), 0) AS m FROM br GROUP BY d), bench AS (SELECT d, m, exp(sum(ln(1 + m)) OVER (ORDER BY d)) AS v FROM bd)"


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weighted index (d, m, v) of all symbols: product of one plus each day's mean return."""
    m = bars(spark, sf).withColumn("r", change(C("close"))).groupBy("d").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("m"))
    return m.withColumn("v", F.exp(F.sum(F.log1p("m")).over(Window.orderBy("d"))))  # a row a trading day


@query("fd_benchmark", f"WITH {BENCH_SQL} SELECT strftime(d, '%Y-%m-%d') AS d, round(log10(v), 6) AS log_value FROM bench")
def fd_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark(spark, sf).select(text_day("d"), F.round(F.log10("v"), 6).alias("log_value"))


@query("ag_backtest_metrics", f"WITH {BARS_SQL}, e AS (SELECT symbol, d, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS dd FROM bars) SELECT symbol, count(r) AS n, {snap_sql('arg_max(close, d) / arg_min(close, d) - 1')} AS total_return, {snap_sql('pow(arg_max(close, d) / arg_min(close, d), 252.0 / count(r)) - 1')} AS annual_return, {snap_sql('stddev_samp(r) * sqrt(252)')} AS annual_vol, {snap_sql('avg(r) / stddev_samp(r) * sqrt(252)')} AS sharpe, {snap_sql('min(dd)')} AS max_drawdown FROM e GROUP BY 1")
def ag_backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return curve_metrics(bars(spark, sf).select("symbol", "d", C("close").alias("v")), "symbol")


def curve_metrics(curve: DataFrame, key: str) -> DataFrame:
    """Return, volatility, Sharpe ratio and drawdown of each curve (key, d, v). The Sharpe ratio of a flat curve is NaN, and
    what is taken over a value of zero is infinite or NaN, as doubles divide."""
    w = Window.partitionBy(key).orderBy("d")
    e = curve.select(key, "d", "v", F.lag("v").over(w).alias("before"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))
    e = e.select(key, "d", "v", (quotient(C("v"), C("before")) - 1).alias("r"), (quotient(C("v"), C("peak")) - 1).alias("dd"))
    whole = quotient(F.max_by("v", "d"), F.min_by("v", "d"))
    yearly = F.when(F.count("r") > 0, F.pow(whole, F.try_divide(F.lit(252.0), F.count("r")))).otherwise(whole)  # one row is no time
    return e.groupBy(key).agg(
        F.count("r").alias("n"), snap_any(whole - 1).alias("total_return"), snap_any(yearly - 1).alias("annual_return"), snap_any(F.stddev_samp("r") * math.sqrt(252)).alias("annual_vol"),
        snap_any(quotient(F.avg("r"), F.stddev_samp("r")) * math.sqrt(252)).alias("sharpe"), snap_any(F.min("dd")).alias("max_drawdown"),
    )


@query("ag_portfolio_metrics")
def ag_portfolio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the backtest's equity curves."""
    return curve_metrics(equity(spark, sf).select("strategy", "d", C("equity").alias("v")), "strategy")


@query("ag_monthly_returns", f"WITH {BARS_SQL}, m AS (SELECT symbol, strftime(d, '%Y-%m') AS month, arg_max(close, d) AS last, arg_min(close, d) AS first FROM bars GROUP BY 1, 2) SELECT symbol, month, {snap_sql('last / coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY month), first) - 1')} AS ret FROM m")
def ag_monthly_returns(spark: SparkSession, sf: str) -> DataFrame:
    m = bars(spark, sf).groupBy("symbol", F.date_format("d", "yyyy-MM").alias("month")).agg(F.max_by("close", "d").alias("last"), F.min_by("close", "d").alias("first"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy("symbol").orderBy("month")), C("first"))
    return m.select("symbol", "month", snap(C("last") / before - 1).alias("ret"))


@query("fd_buy_hold", f"WITH {BARS_SQL} SELECT symbol, strftime(d, '%Y-%m-%d') AS d, {snap_sql('100000.0 / first_value(close) OVER (PARTITION BY symbol ORDER BY d) * close', 2)} AS equity FROM bars")
def fd_buy_hold(spark: SparkSession, sf: str) -> DataFrame:
    first = F.first("close").over(Window.partitionBy("symbol").orderBy("d"))
    return bars(spark, sf).select("symbol", text_day("d"), snap(F.lit(100000.0) / first * C("close"), 2).alias("equity"))


@query("fd_lookahead", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d, CASE WHEN o_orderkey % 50 = 0 THEN 'AVAILABLE_TOO_LATE' WHEN o_orderkey % 33 = 0 THEN 'UNKNOWN_VERSION' ELSE '' END AS problem FROM orders")
def fd_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    """Scores must be known before the day they trade: feature time, then availability, then that day's session."""
    k, day = C("o_orderkey"), F.to_date("o_orderdate")
    o = table(spark, sf, "orders").select(k, day.alias("d"), F.date_sub(day, 1).alias("feature"), F.when(k % 50 == 0, day).otherwise(F.date_sub(day, 1)).alias("available"), F.when(k % 33 == 0, "unknown").otherwise("v1").alias("version"))
    problem = F.when((C("feature") > C("available")) | (C("available") >= C("d")), "AVAILABLE_TOO_LATE").when(C("version").isin("unknown", ""), "UNKNOWN_VERSION").otherwise("")
    return o.select("o_orderkey", text_day("d"), problem.alias("problem"))


@query("fd_limit_coverage", f"WITH {BARS_SQL}, c AS (SELECT d, symbol, symbol % 3 <> 0 AS has_up, symbol % 4 <> 0 AS has_down FROM bars) SELECT strftime(d, '%Y-%m-%d') AS d, count(*) AS cells, count(*) FILTER (has_up OR has_down) AS covered, count(*) FILTER (NOT has_up) AS buy_fallback, count(*) FILTER (NOT has_down) AS sell_fallback FROM c GROUP BY 1")
def fd_limit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    up, down = C("symbol") % 3 != 0, C("symbol") % 4 != 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return bars(spark, sf).groupBy("d").agg(F.count("*").alias("cells"), n(up | down).alias("covered"), n(~up).alias("buy_fallback"), n(~down).alias("sell_fallback")).select(text_day("d"), "cells", "covered", "buy_fallback", "sell_fallback")


# ---- statistics of strategies


@query("ag_bh_fdr", f"WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 100003) / 100003.0::DOUBLE AS p FROM orders), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS q, row_number() OVER (ORDER BY p, id) AS k FROM p) SELECT id, {snap_sql('least(1.0, min(q) OVER (ORDER BY k DESC))', 8)} AS adjusted, min(q) OVER (ORDER BY k DESC) <= 0.05 AS rejected FROM r")
def ag_bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").select(C("o_orderkey").alias("id"), ((C("o_orderkey") * 7919) % 100003 / 100003.0).alias("p"))
    return adjusted_p(p).select("id", snap(C("adjusted"), 8).alias("adjusted"), (C("adjusted") <= 0.05).alias("rejected"))


def adjusted_p(p: DataFrame) -> DataFrame:
    """Benjamini-Hochberg adjusted p values of ``p`` (id, p): the least of p n / k from each rank on."""
    n = p.agg(F.count("*").alias("n"))
    q = ranked(p, C("p"), C("id")).join(F.broadcast(n)).withColumn("q", C("p") * C("n") / C("rank"))
    # A least of those behind is a largest of the negated ones before, in the order turned round.
    back = running_max_before(q.withColumn("m", -C("q")), "m", "behind", F.desc("rank"))
    return back.withColumn("adjusted", F.least(F.lit(1.0), -F.greatest(C("m"), C("behind")))).drop("m", "behind")


#: Coefficients of a rational approximation of the error function, good to 1.5e-7 (fixed values, Abramowitz and Stegun 7.1.26).
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    p, a1, a2, a3, a4, a5 = ERF
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    e = 1 - (((((a5 * t + a4) * t) + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -e).otherwise(e))


def deflated_sharpe(sharpe: Column, n: Column, trials: Column, skew: Column, kurt: Column) -> Column:
    variance = F.greatest(F.lit(1e-12), 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)
    z = (sharpe - F.sqrt(2 * F.log(trials)) / F.sqrt(n)) * F.sqrt(n - 1) / F.sqrt(variance)
    return F.when(n > 1, normal_cdf(z)).otherwise(0.0)


_Z = "(sr - sqrt(2 * ln(100)) / sqrt(n)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - sk * sr + (ku - 1) / 4 * sr * sr))"
_T = f"(1 / (1 + {ERF[0]} * abs(z) / sqrt(2)))"
_ERF_SQL = f"(1 - ((((({ERF[5]} * {_T} + {ERF[4]}) * {_T}) + {ERF[3]}) * {_T} + {ERF[2]}) * {_T} + {ERF[1]}) * {_T} * exp(-z * z / 2))"


@query("ag_deflated_sharpe", f"WITH {BARS_SQL}, r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), m AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sd, count(r) AS n FROM r GROUP BY 1), s AS (SELECT symbol, any_value(mu / sd) AS sr, any_value(n) AS n, avg(pow((r - mu) / sd, 3)) AS sk, avg(pow((r - mu) / sd, 4)) AS ku FROM r JOIN m USING (symbol) GROUP BY 1), z AS (SELECT symbol, {_Z} AS z FROM s) SELECT symbol, {snap_sql(f'0.5 * (1 + CASE WHEN z < 0 THEN -{_ERF_SQL} ELSE {_ERF_SQL} END)')} AS dsr FROM z")
def ag_deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """Probability that a symbol's Sharpe ratio beats the best of a hundred trials without skill."""
    return sharpe_statistics(spark, sf).select("symbol", snap(deflated_sharpe(C("sr"), C("n"), F.lit(100), C("sk"), C("ku"))).alias("dsr"))


def sharpe_statistics(spark: SparkSession, sf: str) -> DataFrame:
    r = bars(spark, sf).select("symbol", change(C("close")).alias("r"))
    m = r.groupBy("symbol").agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd"), F.count("r").alias("n"))
    u = (C("r") - C("mu")) / C("sd")
    return r.join(m, "symbol").groupBy("symbol").agg(F.max(C("mu") / C("sd")).alias("sr"), F.max("n").alias("n"), F.avg(F.pow(u, 3)).alias("sk"), F.avg(F.pow(u, 4)).alias("ku"))


PARTS = 6
_MASKS = [m for m in range(1, 2**PARTS - 1) if bin(m).count("1") <= PARTS // 2]
PBO_SQL = f"""{BARS_SQL}, r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), q AS (SELECT symbol, year(d) % {PARTS} AS part, sum(r) AS s, count(r) AS n FROM r WHERE r IS NOT NULL GROUP BY 1, 2),
 k(mask) AS (SELECT unnest({_MASKS})), io AS (SELECT mask, symbol, sum(s) FILTER ((mask >> part::INT) & 1 = 1) / sum(n) FILTER ((mask >> part::INT) & 1 = 1) AS i, sum(s) FILTER ((mask >> part::INT) & 1 = 0) / sum(n) FILTER ((mask >> part::INT) & 1 = 0) AS o FROM q, k GROUP BY 1, 2),
 b AS (SELECT mask, arg_max(o, ({snap_sql('i', 9)}, -symbol)) AS o, count(*) AS trials FROM io GROUP BY 1), c AS (SELECT mask, count(*) FILTER (io.o <= b.o) AS rank, any_value(trials) AS trials FROM io JOIN b USING (mask) GROUP BY 1)"""


@query("ag_pbo", f"WITH {PBO_SQL} SELECT round(avg((rank <= trials / 2.0)::INT), 8) AS pbo, count(*) AS splits FROM c")
def ag_pbo(spark: SparkSession, sf: str) -> DataFrame:
    """Share of splits of the years in which the trial (here a symbol) that is best within the chosen parts is in the lower
    half outside them. Sums per part make every split's means without reading returns again."""
    return overfitting(spark, sf)


def overfitting(spark: SparkSession, sf: str) -> DataFrame:
    r = bars(spark, sf).select(C("symbol").alias("trial"), (F.year("d") % PARTS).alias("part"), change(C("close")).alias("r"))
    return overfitting_of(r)


def overfitting_of(returns: DataFrame) -> DataFrame:
    """One row, ``pbo`` and ``splits``, of ``returns`` (trial, part, r), part below PARTS."""
    q = returns.where("r is not null").groupBy("trial", "part").agg(F.sum("r").alias("s"), F.count("r").alias("n"))
    x = q.select("*", F.explode(F.array(*map(F.lit, _MASKS))).alias("mask"))
    inside = F.expr("shiftright(mask, part) & 1") == 1
    mean = lambda c: F.sum(F.when(c, C("s"))) / F.sum(F.when(c, C("n")))
    io = x.groupBy("mask", "trial").agg(mean(inside).alias("i"), mean(~inside).alias("o"))
    best = io.groupBy("mask").agg(F.max_by("o", F.struct(snap(C("i"), 9).alias("a"), (-C("trial")).alias("b"))).alias("chosen"), F.count("*").alias("trials"))
    c = io.join(best, "mask").groupBy("mask").agg(F.sum(F.when(C("o") <= C("chosen"), 1).otherwise(0)).alias("rank"), F.max("trials").alias("trials"))
    return c.agg(F.round(F.avg((C("rank") <= C("trials") / 2.0).cast("double")), 8).alias("pbo"), F.count("*").alias("splits"))


WALK_SQL = f"""{BARS_SQL}, x AS (SELECT symbol, d, close / lag(close, 20) OVER s - 1 AS score, lead(close, 5) OVER s / close - 1 AS ahead FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)),
 dd AS (SELECT d, ntile(4) OVER (ORDER BY d) - 1 AS w FROM (SELECT DISTINCT d FROM x)), ic AS (SELECT d, any_value(w) AS w, corr(score, ahead) AS ic FROM x JOIN dd USING (d) WHERE score IS NOT NULL AND ahead IS NOT NULL GROUP BY d HAVING count(*) > 2 AND stddev_pop(score) > 0 AND stddev_pop(ahead) > 0), wf AS (SELECT w, avg(ic) AS ic, count(*) AS days FROM ic GROUP BY w)"""


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Mean daily correlation of score and five-bar return in each of four consecutive windows of days."""
    w = Window.partitionBy("symbol").orderBy("d")
    x = bars(spark, sf).select("symbol", "d", change(C("close"), 20).alias("score"), (F.lead("close", 5).over(w) / C("close") - 1).alias("ahead"))
    days = x.select("d").distinct().withColumn("w", F.ntile(4).over(Window.orderBy("d")) - 1)  # a row a trading day
    g = x.where("score is not null and ahead is not null").join(F.broadcast(days), "d").groupBy("d").agg(F.max("w").alias("w"), F.corr("score", "ahead").alias("ic"), F.count("*").alias("n"), F.stddev_pop("score").alias("a"), F.stddev_pop("ahead").alias("b"))
    return g.where("n > 2 and a > 0 and b > 0").groupBy("w").agg(F.avg("ic").alias("ic"), F.count("*").alias("days"))


@query("ag_walkforward", f"WITH {WALK_SQL} SELECT w::INT AS w, {snap_sql('ic')} AS ic, days, ic > 0 AS passes FROM wf")
def ag_walkforward(spark: SparkSession, sf: str) -> DataFrame:
    return walk_forward(spark, sf).select("w", snap(C("ic")).alias("ic"), "days", (C("ic") > 0).alias("passes"))


#: Gates of a strategy: adjusted p value, deflated Sharpe ratio, probability of overfitting, share of windows that hold up.
ALPHA, LEAST_DSR, MOST_PBO, LEAST_WINDOWS = 0.05, 0.5, 0.35, 0.5


def strategy_verdicts(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """(trial, adjusted_p, deflated_sharpe, pbo, windows, passed, reasons) of each trial of ``returns`` (trial, part, r).

    The p value is that of a mean return above 0; it is adjusted for the false discovery rate over all trials, and the Sharpe
    ratio is deflated by their number. Overfitting is a fact of the family, and so is the share of its walk-forward
    ``windows`` (ic) with a positive correlation. Every gate that fails is a reason. A trial without returns, or whose
    returns don't vary, has a p value of 1 and a deflated Sharpe ratio of 0.
    """
    m = returns.groupBy("trial").agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd"), F.count("r").alias("n"))
    m = m.withColumn("sr", F.when(C("sd") > 0, C("mu") / C("sd")))
    p = adjusted_p(m.select(C("trial").alias("id"), F.coalesce(1 - normal_cdf(C("sr") * F.sqrt("n")), F.lit(1.0)).alias("p")))
    trials = m.agg(F.count("*").alias("trials"))  # one row
    family = overfitting_of(returns).join(windows.agg(F.avg((C("ic") > 0).cast("double")).alias("windows"))).join(trials)
    x = m.join(p.select(C("id").alias("trial"), C("adjusted").alias("adjusted_p")), "trial").join(F.broadcast(family))
    x = x.withColumn("deflated_sharpe", F.coalesce(deflated_sharpe(C("sr"), C("n"), C("trials"), F.lit(0.0), F.lit(3.0)), F.lit(0.0)))
    failed = {
        "FDR_FAILED": C("adjusted_p") > ALPHA, "DEFLATED_SHARPE_FAILED": C("deflated_sharpe") < LEAST_DSR, "PBO_FAILED": ~(C("pbo") <= MOST_PBO),
        "WALK_FORWARD_FAILED": ~(F.coalesce("windows", F.lit(0.0)) >= LEAST_WINDOWS),
    }
    reasons = F.concat_ws(",", *(F.when(c, name) for name, c in failed.items()))
    return x.select("trial", "adjusted_p", "deflated_sharpe", "pbo", "windows", (reasons == "").alias("passed"), reasons.alias("reasons"))


def _cdf_sql(z: str) -> str:
    e = _ERF_SQL.replace("z", f"({z})").replace(f"e({z})ro", "zero")
    return f"(0.5 * (1 + CASE WHEN ({z}) < 0 THEN -{e} ELSE {e} END))"


_DSR_Z = "(sr - sqrt(2 * ln(trials)) / sqrt(n)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 + 0.5 * sr * sr))"
VALIDATE_SQL = f"""{PBO_SQL}, {WALK_SQL.replace(BARS_SQL + ', ', '')}, tm AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sd, count(r) AS n FROM r GROUP BY 1), ts AS (SELECT symbol, n, CASE WHEN sd > 0 THEN mu / sd END AS sr, count(*) OVER () AS trials FROM tm),
 tp AS (SELECT *, coalesce(1 - {_cdf_sql('sr * sqrt(n)')}, 1) AS p FROM ts), tq AS (SELECT *, p * trials / row_number() OVER (ORDER BY p, symbol) AS q, row_number() OVER (ORDER BY p, symbol) AS k FROM tp),
 tv AS (SELECT symbol, least(1.0, min(q) OVER (ORDER BY k DESC)) AS ap, CASE WHEN n > 1 THEN coalesce({_cdf_sql(_DSR_Z)}, 0) ELSE 0 END AS dsr FROM tq), fam AS (SELECT (SELECT round(avg((rank <= trials / 2.0)::INT), 8) FROM c) AS pbo, (SELECT avg((ic > 0)::INT) FROM wf) AS windows)"""


@query("ag_validate_strategy", f"WITH {VALIDATE_SQL} SELECT symbol AS trial, {snap_sql('ap')} AS adjusted_p, {snap_sql('dsr')} AS deflated_sharpe, pbo, windows, concat_ws(',', CASE WHEN ap > {ALPHA} THEN 'FDR_FAILED' END, CASE WHEN dsr < {LEAST_DSR} THEN 'DEFLATED_SHARPE_FAILED' END, CASE WHEN NOT pbo <= {MOST_PBO} THEN 'PBO_FAILED' END, CASE WHEN NOT coalesce(windows, 0) >= {LEAST_WINDOWS} THEN 'WALK_FORWARD_FAILED' END) AS reasons FROM tv, fam")
def ag_validate_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Every symbol, held as a strategy of its own, against all gates."""
    r = bars(spark, sf).select(C("symbol").alias("trial"), (F.year("d") % PARTS).alias("part"), change(C("close")).alias("r"))
    return strategy_verdicts(r, walk_forward(spark, sf)).select("trial", *(snap(C(x)).alias(x) for x in ("adjusted_p", "deflated_sharpe")), "pbo", "windows", "reasons")


#: Largest fall from a peak with which a backtest passes.
MOST_DRAWDOWN = 0.35


@query("fd_evaluate_strategy")
def fd_evaluate_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """The backtested strategies: metrics of their curves, the gates over their daily returns, and a drawdown gate. The fold
    beneath has no SQL; ``strategy_verdicts`` and ``curve_metrics`` have."""
    e = materialised(equity(spark, sf).select(C("strategy").alias("trial"), "d", C("equity").alias("v")))
    m = curve_metrics(e, "trial")
    r = e.select("trial", (F.year("d") % PARTS).alias("part"), (quotient(C("v"), F.lag("v").over(Window.partitionBy("trial").orderBy("d"))) - 1).alias("r"))
    v = strategy_verdicts(r, walk_forward(spark, sf)).join(m.select("trial", "total_return", "sharpe", "max_drawdown"), "trial")
    deep = C("max_drawdown") < -MOST_DRAWDOWN
    reasons = F.concat_ws(",", F.when(C("reasons") != "", C("reasons")), F.when(deep, "DRAWDOWN_FAILED"))
    out = v.select(C("trial").alias("strategy"), "total_return", "sharpe", "max_drawdown", "adjusted_p", "deflated_sharpe", "pbo", "windows", reasons.alias("reasons"))
    return out.withColumn("passed", C("reasons") == "")


# ---- regimes over time


def regime_days(spark: SparkSession, sf: str) -> DataFrame:
    p = S.regime_probabilities(inputs())
    best = S.most_likely(p)
    return scored_days(spark, sf).select(F.lit("all").alias("market"), "d", best.alias("x")).select("market", "d", C("x.name").alias("regime"), C("x.p").alias("p"))


_NEED = "CASE c.regime WHEN 'high_position_retreat' THEN 1 WHEN 'range' THEN 3 ELSE 2 END"
_URGENT = "c.regime IN ('high_position_retreat', 'downtrend')"
_N = "CASE WHEN c.regime = s.cand THEN s.n + 1 ELSE 1 END"
_SWITCH = f"(c.regime <> s.conf AND {_N} >= {_NEED} AND ({_URGENT} OR (c.p >= s.p + 0.08 AND s.days + 1 >= 2)))"
MACHINE_SQL = f"""{REGIME_SQL}, cd AS (SELECT row_number() OVER (ORDER BY d) AS i, d, {ARGMAX_SQL} AS regime, greatest(p1, p2, p3, p4, p5, p6) AS p FROM rp),
 sm(i, conf, cand, n, days, p, status) AS (SELECT i, regime, NULL::VARCHAR, 0, 1, p, 'stable' FROM cd WHERE i = 1 UNION ALL
 SELECT c.i, CASE WHEN {_SWITCH} THEN c.regime ELSE s.conf END, CASE WHEN c.regime = s.conf OR {_SWITCH} THEN NULL ELSE c.regime END, CASE WHEN c.regime = s.conf OR {_SWITCH} THEN 0 ELSE {_N} END,
  CASE WHEN {_SWITCH} THEN 1 ELSE s.days + 1 END, CASE WHEN c.regime = s.conf OR {_SWITCH} THEN c.p ELSE s.p END, CASE WHEN c.regime = s.conf THEN 'stable' WHEN {_SWITCH} THEN 'confirmed_switch' ELSE 'watch_switch' END
  FROM sm s JOIN cd c ON c.i = s.i + 1)"""


@query("fd_regime_machine", f"WITH RECURSIVE {MACHINE_SQL} SELECT strftime(cd.d, '%Y-%m-%d') AS d, conf AS confirmed, cand AS candidate, n AS candidate_days, days AS confirmed_days, sm.p AS confidence, status FROM sm JOIN cd USING (i)")
def fd_regime_machine(spark: SparkSession, sf: str) -> DataFrame:
    return confirm(regime_days(spark, sf)).select(text_day("d"), "confirmed", "candidate", "candidate_days", "confirmed_days", "confidence", "status")


@query("crud_regime_history", f"WITH RECURSIVE {MACHINE_SQL}, h AS (SELECT cd.d, conf, sum((status = 'confirmed_switch')::INT) OVER (ORDER BY i) AS k FROM sm JOIN cd USING (i)) SELECT conf AS regime, strftime(min(d), '%Y-%m-%d') AS started, strftime(max(d), '%Y-%m-%d') AS last_day, count(*) AS days FROM h GROUP BY k, conf")
def crud_regime_history(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of one confirmed regime."""
    m = confirm(regime_days(spark, sf)).withColumn("k", F.sum((C("status") == "confirmed_switch").cast("int")).over(Window.partitionBy("market").orderBy("d")))
    return m.groupBy("k", C("confirmed").alias("regime")).agg(F.min("d").alias("started"), F.max("d").alias("last_day"), F.count("*").alias("days")).select("regime", text_day("started"), text_day("last_day"), "days")
