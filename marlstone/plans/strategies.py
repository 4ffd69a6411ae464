"""Strategy definitions of a table checked, compiled strategies over all bars, indicators of several passes, report texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from marlstone.functions.indicators import INDICATORS
from marlstone.functions.series import by_day, change
from marlstone.operators import strategy as S
from marlstone.plans.joins import text_day
from marlstone.plans.market import DAY_SQL, ewm_sql, indicator_frame, mean_sql
from marlstone.plans.sectors import snap, snap_sql
from marlstone.registry import query
from marlstone.sources.tables import BARS_SQL, bars, table

C = F.col

#: Columns of the frame that strategies may name.
FRAME = S.BAR | {"ma5", "ma20", "ma60", "dif", "dea", "macd", "volume_ratio20"}


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy definition, as JSON, for every part; its faults follow from the part's number."""
    k = C("p_partkey")
    universe = F.when(k % 19 == 0, '[{"gt": ["future_data", 1]}]').otherwise(F.format_string('[{"gte": ["volume", %s]}]', C("p_size").cast("string")))
    entry = F.when(k % 17 == 0, '[{"rising": ["close", -3]}]').when(k % 23 == 0, '[{"near": ["close", "ma20"]}]').otherwise('[{"cross_up": ["ma5", "ma20"]}]')
    leave = F.when(k % 13 == 0, "[]").otherwise('[{"lt": ["close", "ma20"]}]')
    ranking = F.when(k % 5 == 0, "[]").otherwise('[{"factor": "amount", "weight": 1}]')
    fill = F.element_at(F.array(*map(F.lit, S.FILLS)), (k % 4 + 1).cast("int"))
    execution = F.format_string('{"signal_at": "%s", "fill_at": "%s"}', F.when(k % 11 == 0, "open").otherwise("close"), F.when(k % 7 == 0, "same_close").otherwise(fill))
    whole = '{"name": "s%s", "universe": %s, "entry": %s, "exit": %s, "ranking": %s, "execution": %s}'
    return table(spark, sf, "part").select(k.alias("strategy_id"), F.format_string(whole, k.cast("string"), universe, entry, leave, ranking, execution).alias("definition"))


@F.pandas_udf(StructType().add("codes", ArrayType(StringType())).add("model", StringType()))
def _checked(given: pd.Series) -> pd.DataFrame:
    """Codes of refusal and, of a definition without any, the execution model; a text that is no definition has NO_DEFINITION."""

    def of(text: str | None) -> tuple[list[str], str | None]:
        try:
            s = S.Strategy.of(json.loads(text or ""))
            codes = list(S.refusals(s, FRAME))
        except (ValueError, TypeError, AttributeError):
            return ["NO_DEFINITION"], None
        return codes, None if codes else S.FILLS[s.execution["fill_at"]]

    return pd.DataFrame([of(x) for x in given], columns=["codes", "model"])


_CODES = (
    "concat_ws(',', CASE WHEN k % 13 = 0 THEN 'RULES_MISSING' END, CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN 'INVALID_EXECUTION_TIMELINE' END, "
    "CASE WHEN k % 5 = 0 THEN 'STRATEGY_REQUIRES_RANKING' END, CASE WHEN k % 19 = 0 THEN 'NON_DSL_EXPRESSION' END, CASE WHEN k % 17 = 0 THEN 'LOOKS_AHEAD' END, "
    "CASE WHEN k % 19 = 0 OR (k % 23 = 0 AND k % 17 <> 0) THEN 'FAULTY_RULE' END)"
)


@query("pl_strategy_compile", f"WITH c AS (SELECT p_partkey AS k, {_CODES} AS codes FROM (SELECT p_partkey, p_partkey AS k FROM part)) SELECT k AS strategy_id, codes = '' AS accepted, codes, CASE WHEN codes = '' THEN CASE k % 4 WHEN 0 THEN 'NEXT_OPEN' WHEN 1 THEN 'NEXT_CLOSE' WHEN 2 THEN 'VWAP' ELSE 'LIMIT_PRICE' END END AS model FROM c")
def pl_strategy_compile(spark: SparkSession, sf: str) -> DataFrame:
    """Every definition of a table: accepted with its execution model, or refused with the codes of all its faults."""
    c = definitions(spark, sf).select("strategy_id", _checked("definition").alias("c"))
    return c.select("strategy_id", (F.size("c.codes") == 0).alias("accepted"), F.array_join("c.codes", ",").alias("codes"), "c.model")


TREND = S.Strategy(
    "trend",
    entry=[{"gt": ["close", "ma60"]}, {"cross_up": ["ma5", "ma20"]}],
    exit=[{"cross_down": ["ma5", "ma20"]}],
    ranking=[{"factor": "amount", "weight": 1}],
    universe=[{"gte": ["volume", 20]}],
    portfolio={"top": 3},
)
REVERSAL = S.Strategy(
    "reversal",
    entry=[{"lt": ["close", "ma20"]}, {"gte": ["volume_ratio20", 1.5]}],
    exit=[{"cross_up": ["close", "ma20"]}],
    ranking=[{"factor": "volume", "weight": -1}],
    portfolio={"top": 5},
    execution={"signal_at": "close", "fill_at": "limit_price", "limit_offset": -0.02},
)

_SIGNALS_SQL = f"""{BARS_SQL}, q AS (SELECT *, {mean_sql('close', 5)} AS ma5, {mean_sql('close', 20)} AS ma20, {mean_sql('close', 60)} AS ma60, volume / nullif({mean_sql('volume', 20)}, 0) AS vr FROM bars),
p AS (SELECT *, lag(close) OVER s AS close1, lag(ma5) OVER s AS ma5b, lag(ma20) OVER s AS ma20b, lead(d) OVER s AS nd, lead(open) OVER s AS no, lead(low) OVER s AS nl, lead(high) OVER s AS nh, lead(volume) OVER s AS nv FROM q WINDOW s AS (PARTITION BY symbol ORDER BY d)),
e AS (SELECT 'trend' AS strategy, symbol, d, coalesce(volume >= 20 AND close > ma60 AND ma5b <= ma20b AND ma5 > ma20, false) AS enters, coalesce(ma5b >= ma20b AND ma5 < ma20, false) AS exits, amount AS score, 3 AS top, 'NEXT_OPEN' AS model, nd, no AS price, nv FROM p
UNION ALL SELECT 'reversal', symbol, d, coalesce(close < ma20 AND vr >= 1.5, false), coalesce(close1 <= ma20b AND close > ma20, false), -volume, 5, 'LIMIT_PRICE', nd, CASE WHEN close * 0.98 BETWEEN nl AND nh THEN close * 0.98 END, nv FROM p),
r AS (SELECT * REPLACE (enters AND row_number() OVER (PARTITION BY strategy, d ORDER BY enters DESC, score DESC, symbol) <= top AS enters), row_number() OVER (PARTITION BY strategy, d ORDER BY enters DESC, score DESC, symbol) AS place FROM e WHERE enters OR exits)"""


@query("pl_strategy_signals", f"WITH {_SIGNALS_SQL} SELECT strategy, symbol, {DAY_SQL}, enters, CASE WHEN enters THEN place END AS place, exits, model, strftime(nd, '%Y-%m-%d') AS fill_d, {snap_sql('price', 4)} AS price, CASE WHEN nd IS NULL THEN 'NO_NEXT_SESSION' WHEN coalesce(nv, 0) <= 0 THEN 'SUSPENDED' WHEN price IS NULL THEN 'LIMIT_PRICE_NOT_REACHED' END AS reason FROM r WHERE enters OR exits")
def pl_strategy_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Entries, exits and next-session fills of two compiled strategies over all bars."""
    s = S.signals(indicator_frame(spark, sf), [TREND, REVERSAL])
    return s.select("strategy", "symbol", text_day("d"), "enters", "place", "exits", "model", text_day("fill_d"), snap(C("price"), 4).alias("price"), "reason")


_STD = "CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 END"


@query("reg_smoothed", f"WITH {BARS_SQL}, r AS (SELECT *, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY d) <> 0 THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 END AS r, {ewm_sql('close', '(2.0/13)')} AS ema12, {ewm_sql('close', '(2.0/9)')} - {ewm_sql('close', '(2.0/18)')} AS dif FROM bars), m AS (SELECT *, {ewm_sql('dif', '0.2')} AS dea, {_STD} AS std20 FROM r WINDOW w20 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, {DAY_SQL}, {snap_sql('ema12', 4)} AS ema12, {snap_sql('dif', 4)} AS m_dif, {snap_sql('dea', 4)} AS m_dea, {snap_sql('(dif - dea) * 2', 4)} AS m_hist, {snap_sql('std20', 4)} AS std20 FROM m")
def reg_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    """The registry's indicators of several passes, and the deviation of returns."""
    b = bars(spark, sf).withColumn("return", change(C("close")))
    asked = {"ema12": ("ema", {"window": 12}), "m": ("macd", {"fast": 8, "slow": 17, "signal": 9}), "std20": ("rolling_std", {"window": 20})}
    made = INDICATORS.apply(b, asked)
    return made.select("symbol", text_day("d"), *(snap(C(c), 4).alias(c) for c in ("ema12", "m_dif", "m_dea", "m_hist", "std20")))


# Wording of a report.
TITLE, KEY_FIGURES, MONTHS, NONE = "# 组合回测报告", "## 核心指标", "## 月度收益", "暂无"


def percent(x: Column) -> Column:
    """Two places of a percentage; a missing one in words."""
    return F.when(x.isNotNull(), F.format_string("%.2f%%", F.round(x, 4) * 100)).otherwise(NONE)


def report(metrics: DataFrame, months: DataFrame, key: str) -> DataFrame:
    """Markdown of each curve (key, text) from its metrics, with last and benchmark value, and a table of its months (key, month, ret).

    Months are put in order within a key, of which a curve has few. A curve without months has no table of them.
    """
    line = F.concat(F.lit("| "), C("month"), F.lit(" | "), percent(C("ret")), F.lit(" |"))
    rows = months.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("month", line.alias("line")))).alias("months"))
    money = lambda c: F.when(c.isNotNull(), F.format_string("%,.2f", F.round(c, 2))).otherwise(NONE)
    facts = {"期末净值": money(C("last")), "基准期末净值": money(C("benchmark")), "总收益率": percent(C("total_return")), "年化收益": percent(C("annual_return")), "年化波动": percent(C("annual_vol")), "夏普比率": F.format_string("%.2f", F.coalesce(F.round("sharpe", 2), F.lit(0.0))), "最大回撤": percent(C("max_drawdown"))}
    head = F.array(F.lit(TITLE), F.lit(""), F.lit(KEY_FIGURES), F.lit(""), *(F.concat(F.lit(f"- {name}："), value) for name, value in facts.items()))
    table_ = F.concat(F.array(F.lit(""), F.lit(MONTHS), F.lit(""), F.lit("| 月份 | 收益 |"), F.lit("| --- | --- |")), F.transform("months", lambda m: m["line"]))
    text = F.array_join(F.when(F.size("months") > 0, F.concat(head, table_)).otherwise(head), "\n")
    return metrics.join(rows, key, "left").select(key, text.alias("text"))


_P = "coalesce(printf('%.2f%%', round({0}, 4) * 100), '暂无')"
_REPORT_SQL = f"""{BARS_SQL}, x AS (SELECT symbol, d, close, close / lag(close) OVER w - 1 AS r, close / max(close) OVER w - 1 AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
a AS (SELECT symbol, arg_max(close, d) / arg_min(close, d) AS whole, count(r) AS n, stddev_samp(r) AS sd, avg(r) AS mu, min(dd) AS dd FROM x GROUP BY 1),
k AS (SELECT symbol, {snap_sql('whole - 1', 4)} AS total, {snap_sql('pow(whole, 252.0 / nullif(n, 0)) - 1', 4)} AS annual, {snap_sql('sd * sqrt(252)', 4)} AS vol, {snap_sql('mu / nullif(sd, 0) * sqrt(252)', 2)} AS sharpe, {snap_sql('dd', 4)} AS worst FROM a),
mm AS (SELECT symbol, strftime(d, '%Y-%m') AS month, arg_max(close, d) AS last, arg_min(close, d) AS first FROM bars GROUP BY 1, 2), mr AS (SELECT symbol, month, {snap_sql('last / coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY month), first) - 1', 4)} AS ret FROM mm),
mt AS (SELECT symbol, string_agg('| ' || month || ' | ' || {_P.format('ret')} || ' |', chr(10) ORDER BY month) AS months FROM mr GROUP BY 1)"""
_LINES = ["'# 组合回测报告'", "''", "'## 核心指标'", "''", "'- 期末净值：' || format('{:,.2f}', round(1000000 * (1 + total), 2))", "'- 基准期末净值：暂无'", f"'- 总收益率：' || {_P.format('total')}", f"'- 年化收益：' || {_P.format('annual')}", f"'- 年化波动：' || {_P.format('vol')}", "'- 夏普比率：' || printf('%.2f', coalesce(sharpe, 0))", f"'- 最大回撤：' || {_P.format('worst')}", "''", "'## 月度收益'", "''", "'| 月份 | 收益 |'", "'| --- | --- |'", "months"]


@query("sc_report_text", f"WITH {_REPORT_SQL} SELECT symbol, {' || chr(10) || '.join(_LINES)} AS text FROM k JOIN mt USING (symbol)")
def sc_report_text(spark: SparkSession, sf: str) -> DataFrame:
    """The report of every symbol held from first to last day with a million; there is no benchmark in it."""
    b = bars(spark, sf)
    m = b.groupBy("symbol", F.date_format("d", "yyyy-MM").alias("month")).agg(F.max_by("close", "d").alias("last"), F.min_by("close", "d").alias("first"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy("symbol").orderBy("month")), C("first"))
    months = m.select("symbol", "month", snap(C("last") / before - 1, 4).alias("ret"))
    x = b.select("symbol", "d", "close", change(C("close")).alias("r"), (C("close") / F.max("close").over(by_day().rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"))
    a = x.groupBy("symbol").agg((F.max_by("close", "d") / F.min_by("close", "d")).alias("whole"), F.nullif(F.count("r"), F.lit(0)).alias("n"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mu"), F.min("dd").alias("dd"))
    k = a.select(
        "symbol", snap(C("whole") - 1, 4).alias("total_return"), snap(F.pow("whole", F.lit(252.0) / C("n")) - 1, 4).alias("annual_return"), snap(C("sd") * F.sqrt(F.lit(252.0)), 4).alias("annual_vol"),
        snap(C("mu") / F.nullif("sd", F.lit(0.0)) * F.sqrt(F.lit(252.0)), 2).alias("sharpe"), snap(C("dd"), 4).alias("max_drawdown"),
    )
    k = k.withColumns({"last": F.lit(1000000) * (1 + C("total_return")), "benchmark": F.lit(None).cast("double")})
    return report(k, months, "symbol")
