"""Portfolios, policies, outcomes, attribution, reviews and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scores as S
from marlstone.operators import portfolio as PF
from marlstone.operators.joins import as_of
from marlstone.operators.ordering import ranked
from marlstone.plans.joins import WINDOWS_SQL, text_day, windows
from marlstone.plans.scores import _OPP, REJECT_SQL, clip_sql, rejections
from marlstone.plans.sectors import snap, snap_sql
from marlstone.registry import query
from marlstone.sources.tables import BARS_SQL, CANDIDATES_SQL, bars, candidates, table

C = F.col


# ---- ranking and portfolios

_ELIGIBLE = f"{CANDIDATES_SQL}, el AS (SELECT symbol, theme, sector, round(round({clip_sql(_OPP, 0, 100)}, 9), 4) AS score, {REJECT_SQL} AS reasons FROM cand)"


def opportunity(spark: SparkSession, sf: str) -> DataFrame:
    names = [k for _, k in S.OPPORTUNITY]
    c = candidates(spark, sf)
    return c.where(F.size(rejections()) == 0).select("symbol", "theme", "sector", S.opportunity_score({k: C(k) for k in names}).alias("score"))


@query("wf_rank_dense_ties", f"WITH {_ELIGIBLE} SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM el WHERE reasons = ''")
def wf_rank_dense_ties(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(opportunity(spark, sf).select("symbol", "score"), F.desc("score"), C("symbol"))


@query("pl_opportunity", f"WITH {_ELIGIBLE} SELECT symbol, theme, score, row_number() OVER (PARTITION BY theme ORDER BY score DESC, symbol) AS theme_rank FROM el WHERE reasons = '' QUALIFY theme_rank <= 5")
def pl_opportunity(spark: SparkSession, sf: str) -> DataFrame:
    """Eligibility, score and the best five of each theme."""
    k = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("score"), "symbol")).cast("long")
    return opportunity(spark, sf).withColumn("theme_rank", k).where("theme_rank <= 5").select("symbol", "theme", "score", "theme_rank")


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty portfolios: eligible candidates beside what is held."""
    c = opportunity(spark, sf).select("symbol", "theme", "sector", F.least(F.lit(100.0), C("score") * 1.5).alias("score"))
    p = table(spark, sf, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("symbol"), F.floor(C("c_acctbal") / 25).cast("long").alias("held"), C("c_mktsegment").alias("own"))
    all_ = c.join(p, "symbol", "full")
    k = C("symbol") % 20
    regime = F.element_at(F.array(*map(F.lit, ("crowding", "rotation", "range", "high_position_retreat", "downtrend", "other"))), (k % 6 + 1).cast("int"))
    theme = F.coalesce("theme", "own")
    return all_.select(k.alias("portfolio"), "symbol", "score", F.coalesce("held", F.lit(0)).alias("held"), theme.alias("theme"), "sector", F.when(theme.endswith("1"), "ones").when(theme.endswith("2"), "twos").alias("cluster"), regime.alias("regime"))


_BASIS = f"""{_ELIGIBLE}, ps0 AS (SELECT coalesce(c.symbol, p.symbol) AS symbol, CASE WHEN c.score IS NOT NULL THEN least(100.0, c.score * 1.5) END AS score, coalesce(held, 0) AS held, coalesce(c.theme, p.own) AS theme, c.sector FROM (SELECT * FROM el WHERE reasons = '') c
  FULL JOIN (SELECT c_custkey AS symbol, floor(c_acctbal / 25)::BIGINT AS held, c_mktsegment AS own FROM customer WHERE c_acctbal > 0) p ON c.symbol = p.symbol),
ps AS (SELECT symbol % 20 AS portfolio, *, CASE WHEN theme LIKE '%1' THEN 'ones' WHEN theme LIKE '%2' THEN 'twos' END AS cluster, CASE symbol % 20 % 6 WHEN 0 THEN 9000 WHEN 1 THEN 7500 WHEN 2 THEN 6000 WHEN 3 THEN 3500 WHEN 4 THEN 2000 ELSE 5000 END AS budget,
  CASE WHEN score >= 85 THEN 600 WHEN score >= 72 THEN 300 WHEN score >= 60 THEN 100 ELSE 0 END AS lo, CASE WHEN score >= 85 THEN 1000 WHEN score >= 72 THEN 600 WHEN score >= 60 THEN 300 ELSE 0 END AS hi FROM ps0),
t0 AS (SELECT *, (CASE WHEN score IS NULL THEN held WHEN score < 30 AND held > 0 THEN 0 WHEN score < 45 AND held > 0 THEN (held + 1) // 2 WHEN hi = 0 THEN held WHEN held > hi THEN hi WHEN held >= lo THEN held ELSE least(1000, (lo + hi + 1) // 2) END)::BIGINT AS target FROM ps)"""


def _trim_sql(name: str, source: str, by: str, cap: str, applies: str) -> str:
    over = f"PARTITION BY {by} ORDER BY coalesce(score, -1.0), symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"{name} AS (SELECT * REPLACE ((target - CASE WHEN {applies} THEN greatest(0, least(target, sum(target) OVER (PARTITION BY {by}) - {cap} - coalesce(sum(target) OVER ({over}), 0))) ELSE 0 END)::BIGINT AS target) FROM {source})"


PORTFOLIO_SQL = ", ".join(
    [
        _BASIS,
        _trim_sql("t1", "t0", "portfolio, theme", "4000", "theme IS NOT NULL"),
        _trim_sql("t2", "t1", "portfolio, sector", "5000", "sector IS NOT NULL"),
        _trim_sql("t3", "t2", "portfolio, cluster", "5000", "cluster IS NOT NULL"),
        _trim_sql("t4", "t3", "portfolio", "budget", "true"),
        "t5 AS (SELECT * REPLACE (CASE WHEN target <> held AND abs(target - held) < 100 THEN held ELSE target END AS target) FROM t4)",
        "t6 AS (SELECT * REPLACE (CASE WHEN abs(target - held) > 0 AND sum(abs(target - held)) OVER (PARTITION BY portfolio) - coalesce(sum(abs(target - held)) OVER (PARTITION BY portfolio ORDER BY abs(target - held), symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 3000 THEN held ELSE target END AS target) FROM t5)",
    ]
)


@query("pl_portfolio", f"WITH {PORTFOLIO_SQL} SELECT portfolio, symbol, held, target, CASE WHEN target > held THEN CASE WHEN score >= 85 THEN 'high_conviction' WHEN score >= 72 THEN 'normal' WHEN score >= 60 THEN 'starter' ELSE 'normal' END WHEN target < held THEN CASE WHEN target = 0 THEN 'exit' ELSE 'reduce' END WHEN held > 0 THEN 'hold' ELSE 'watch' END AS action FROM t6")
def pl_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return PF.actions(states(spark, sf)).select("portfolio", "symbol", "held", "target", "action")


@query("wf_cum_trim", f"WITH {_BASIS}, {_trim_sql('t1', 't0', 'portfolio, theme', '4000', 'theme IS NOT NULL')} SELECT portfolio, symbol, target FROM t1")
def wf_cum_trim(spark: SparkSession, sf: str) -> DataFrame:
    df = states(spark, sf).withColumn("target", PF.first_target(C("score"), C("held"))).withColumn("codes", F.array().cast("array<string>"))
    return PF.trim(df, ["portfolio", "theme"], F.lit(4000), C("theme").isNotNull(), "THEME_CAP").select("portfolio", "symbol", "target")


@query("wf_turnover_cancel", f"WITH {_BASIS}, t5 AS (SELECT * REPLACE (CASE WHEN target <> held AND abs(target - held) < 100 THEN held ELSE target END AS target) FROM t0) SELECT portfolio, symbol, CASE WHEN abs(target - held) > 0 AND sum(abs(target - held)) OVER (PARTITION BY portfolio) - coalesce(sum(abs(target - held)) OVER (PARTITION BY portfolio ORDER BY abs(target - held), symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 3000 THEN held ELSE target END AS target FROM t5")
def wf_turnover_cancel(spark: SparkSession, sf: str) -> DataFrame:
    df = states(spark, sf).withColumn("target", PF.first_target(C("score"), C("held"))).withColumn("codes", F.array().cast("array<string>"))
    return PF.rebalance(df).select("portfolio", "symbol", "target")


# ---- policy, suitability and pre-trade checks over orders as proposals

PROPOSAL_SQL = """pr AS (SELECT o_orderkey AS id, (o_orderkey % 151) / 1000::DOUBLE AS weight, (o_orderkey % 7) / 100::DOUBLE AS existing, (o_orderkey % 33) / 100::DOUBLE AS industry, (o_orderkey % 29) / 100::DOUBLE AS theme_w, o_orderkey % 4 = 0 AS drawdown,
 o_orderkey % 37 <> 0 AS liquid, o_orderkey % 41 = 0 AS restricted, o_orderkey % 43 = 0 AS special, CASE o_orderkey % 3 WHEN 0 THEN 'SELL' ELSE 'BUY' END AS side, o_orderkey % 5 AS evidence, (o_orderkey % 11) / 10::DOUBLE AS confidence, (o_orderkey % 13) / 12::DOUBLE AS coverage FROM orders)"""


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), ((k % 151) / 1000.0).alias("weight"), ((k % 7) / 100.0).alias("existing"), ((k % 33) / 100.0).alias("industry"), ((k % 29) / 100.0).alias("theme_w"), (k % 4 == 0).alias("drawdown"),
        (k % 37 != 0).alias("liquid"), (k % 41 == 0).alias("restricted"), (k % 43 == 0).alias("special"), F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"), (k % 5).alias("evidence"),
        ((k % 11) / 10.0).alias("confidence"), ((k % 13) / 12.0).alias("coverage"),
    )


#: Limits of a policy.
SINGLE, INDUSTRY, THEME, DRAWDOWN_SCALE = 0.10, 0.30, 0.25, 0.5


def approved_weight() -> Column:
    """The proposed weight under all soft caps."""
    single = F.greatest(F.lit(0.0), F.when(C("drawdown"), SINGLE * DRAWDOWN_SCALE).otherwise(SINGLE) - C("existing"))
    caps = [single, F.greatest(F.lit(0.0), INDUSTRY - C("industry")), F.greatest(F.lit(0.0), THEME - C("theme_w")), F.when(C("drawdown"), SINGLE * DRAWDOWN_SCALE).otherwise(1.0)]
    return F.round(F.least("weight", *caps), 6)


def hard_rejects() -> Column:
    return S.codes(
        {
            "LIQUIDITY": ~C("liquid"),
            "RESTRICTED_UNIVERSE": C("restricted"),
            "ST_SUSPENSION": (C("side") == "BUY") & C("special"),
            "MINIMUM_EVIDENCE": C("evidence") < 1,
            "MINIMUM_CONFIDENCE": C("confidence") < 0.3,
            "FACTOR_COVERAGE": C("coverage") < 0.5,
        }
    )


_HARD = """array_to_string(list_filter([CASE WHEN coverage < 0.5 THEN 'FACTOR_COVERAGE' END, CASE WHEN NOT liquid THEN 'LIQUIDITY' END, CASE WHEN confidence < 0.3 THEN 'MINIMUM_CONFIDENCE' END, CASE WHEN evidence < 1 THEN 'MINIMUM_EVIDENCE' END,
 CASE WHEN restricted THEN 'RESTRICTED_UNIVERSE' END, CASE WHEN side = 'BUY' AND special THEN 'ST_SUSPENSION' END], lambda x: x IS NOT NULL), ',')"""
_SOFT = "round(least(weight, greatest(0.0, CASE WHEN drawdown THEN 0.05 ELSE 0.10 END - existing), greatest(0.0, 0.30 - industry), greatest(0.0, 0.25 - theme_w), CASE WHEN drawdown THEN 0.05 ELSE 1.0 END), 6)"


@query("pr_policy", f"WITH {PROPOSAL_SQL}, x AS (SELECT id, {_HARD} AS rejections, {_SOFT} AS w, weight FROM pr) SELECT id, rejections, CASE WHEN rejections = '' AND w > 0 THEN w ELSE 0 END::DOUBLE AS approved_weight, w < weight AS adjusted FROM x")
def pr_policy(spark: SparkSession, sf: str) -> DataFrame:
    w, hard = approved_weight(), hard_rejects()
    return proposals(spark, sf).select("id", F.array_join(hard, ",").alias("rejections"), F.when((F.size(hard) == 0) & (w > 0), w).otherwise(0.0).alias("approved_weight"), (w < C("weight")).alias("adjusted"))


@query("sc_policy_explain", f"WITH {PROPOSAL_SQL} SELECT id, 'passed: ' || concat_ws(', ', CASE WHEN liquid THEN 'liquidity' END, CASE WHEN NOT restricted THEN 'universe' END, CASE WHEN evidence >= 1 THEN 'evidence' END, CASE WHEN confidence >= 0.3 THEN 'confidence' END) AS text FROM pr")
def sc_policy_explain(spark: SparkSession, sf: str) -> DataFrame:
    passed = F.concat_ws(", ", F.when(C("liquid"), "liquidity"), F.when(~C("restricted"), "universe"), F.when(C("evidence") >= 1, "evidence"), F.when(C("confidence") >= 0.3, "confidence"))
    return proposals(spark, sf).select("id", F.concat(F.lit("passed: "), passed).alias("text"))


_LEVELS = ("CONSERVATIVE", "BALANCED", "GROWTH", "AGGRESSIVE")


@query("pr_suitability", """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 4 AS investor, o_orderkey // 4 % 4 AS product, (o_orderkey % 151) / 1000::DOUBLE AS weight, o_orderkey % 6 AS has_years, o_orderkey % 5 AS needs_years, o_orderkey % 7 = 0 AS illiquid, o_orderkey % 19 = 0 AS closed FROM orders),
 x AS (SELECT *, array_to_string(list_filter([CASE WHEN closed THEN 'MARKET_NOT_ALLOWED' END, CASE WHEN product > investor THEN 'RISK_MISMATCH' END], lambda v: v IS NOT NULL), ',') AS rejections, least(weight, CASE investor WHEN 0 THEN 0.05 WHEN 1 THEN 0.10 WHEN 2 THEN 0.15 ELSE 0.25 END, CASE WHEN has_years < needs_years THEN 0.05 ELSE 1 END, CASE WHEN illiquid THEN 0.05 ELSE 1 END) AS w FROM s)
 SELECT id, rejections, CASE WHEN rejections <> '' THEN 'REJECTED' WHEN w < weight OR has_years < needs_years OR illiquid THEN 'CONDITIONAL' ELSE 'SUITABLE' END AS status, CASE WHEN rejections <> '' THEN 0 ELSE round(w, 6) END::DOUBLE AS approved_weight FROM x""")
def pr_suitability(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    s = table(spark, sf, "orders").select(
        k.alias("id"), (k % 4).alias("investor"), (F.floor(k / 4) % 4).alias("product"), ((k % 151) / 1000.0).alias("weight"), (k % 6 < k % 5).alias("short"), (k % 7 == 0).alias("illiquid"), (k % 19 == 0).alias("closed")
    )
    cap = F.element_at(F.array(*map(F.lit, (0.05, 0.10, 0.15, 0.25))), (C("investor") + 1).cast("int"))
    w = F.least("weight", cap, F.when(C("short"), 0.05).otherwise(1.0), F.when(C("illiquid"), 0.05).otherwise(1.0))
    bad = S.codes({"MARKET_NOT_ALLOWED": C("closed"), "RISK_MISMATCH": C("product") > C("investor")})
    status = F.when(F.size(bad) > 0, "REJECTED").when((w < C("weight")) | C("short") | C("illiquid"), "CONDITIONAL").otherwise("SUITABLE")
    return s.select("id", F.array_join(bad, ",").alias("rejections"), status.alias("status"), F.when(F.size(bad) > 0, 0.0).otherwise(F.round(w, 6)).alias("approved_weight"))


@query("pr_risk_gate", f"WITH {PROPOSAL_SQL} SELECT id, array_to_string(list_filter([CASE WHEN id % 23 = 0 THEN 'DUPLICATE_ORDER' END, CASE WHEN side = 'BUY' AND id % 9 < id % 5 THEN 'INSUFFICIENT_CASH' END, CASE WHEN NOT liquid THEN 'LIQUIDITY_LIMIT' END, CASE WHEN existing + weight > 0.15 THEN 'POSITION_LIMIT' END, CASE WHEN side = 'SELL' AND id % 6 = 0 THEN 'PRICE_LIMIT_DOWN' END, CASE WHEN side = 'BUY' AND id % 8 = 1 THEN 'PRICE_LIMIT_UP' END, CASE WHEN industry > 0.3 THEN 'SECTOR_LIMIT' END, CASE WHEN weight > 0.10 THEN 'SINGLE_ORDER_LIMIT' END, CASE WHEN id % 31 > 5 AND id % 31 < 8 THEN 'STALE_MARKET_DATA' END, CASE WHEN id % 47 = 0 THEN 'STRATEGY_NOT_ACTIVE' END, CASE WHEN special THEN 'SUSPENDED' END, CASE WHEN theme_w > 0.25 THEN 'THEME_LIMIT' END, CASE WHEN side = 'SELL' AND id % 12 = 3 THEN 'T_PLUS_ONE_LOCKED' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pr")
def pr_risk_gate(spark: SparkSession, sf: str) -> DataFrame:
    k, buys = C("id"), C("side") == "BUY"
    checks = {
        "STALE_MARKET_DATA": (k % 31 > 5) & (k % 31 < 8), "SUSPENDED": C("special"), "PRICE_LIMIT_UP": buys & (k % 8 == 1), "PRICE_LIMIT_DOWN": ~buys & (k % 6 == 0), "SINGLE_ORDER_LIMIT": C("weight") > 0.10,
        "POSITION_LIMIT": C("existing") + C("weight") > 0.15, "THEME_LIMIT": C("theme_w") > 0.25, "SECTOR_LIMIT": C("industry") > 0.3, "LIQUIDITY_LIMIT": ~C("liquid"), "INSUFFICIENT_CASH": buys & (k % 9 < k % 5),
        "T_PLUS_ONE_LOCKED": ~buys & (k % 12 == 3), "DUPLICATE_ORDER": k % 23 == 0, "STRATEGY_NOT_ACTIVE": k % 47 == 0,
    }
    return proposals(spark, sf).select("id", F.array_join(S.codes(checks), ",").alias("reasons"))


# ---- outcomes

OUTCOME_SQL = f"""{BARS_SQL}, {WINDOWS_SQL}, px AS (SELECT decision_id, dw.symbol, entry, exit, arg_max(b0.close, b0.d) AS p0 FROM dw JOIN bars b0 ON b0.symbol = dw.symbol AND b0.d <= dw.entry GROUP BY ALL),
path AS (SELECT decision_id, px.symbol, entry, exit, p0, b.d, b.close / p0 - 1 AS r FROM px LEFT JOIN bars b ON b.symbol = px.symbol AND b.d > px.entry AND b.d <= px.exit),
mk AS (SELECT d, avg(close) AS m FROM bars GROUP BY d),
oc AS (SELECT decision_id, any_value(entry) AS entry, any_value(exit) AS exit, coalesce(arg_max(r, d), 0.0) AS absolute, least(0.0, coalesce(min(r), 0.0)) AS mae, greatest(0.0, coalesce(max(r), 0.0)) AS mfe, count(r) AS bars FROM path GROUP BY 1)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Return, worst and best excursion of each decision from the last close at entry over the bars up to exit."""
    b = bars(spark, sf).select("symbol", "d", "close")
    w = as_of(windows(spark, sf), b.select("symbol", C("d").alias("t"), C("close").alias("p0")), "symbol", "entry", "t", ["t"], ["p0"]).where("p0 is not null")
    held = b.withColumnRenamed("symbol", "s")
    path = w.join(held, (C("s") == C("symbol")) & (C("d") > C("entry")) & (C("d") <= C("exit")), "left").withColumn("r", C("close") / C("p0") - 1)
    zero = F.lit(0.0)
    return path.groupBy("decision_id", "entry", "exit").agg(
        F.coalesce(F.max_by("r", "d"), zero).alias("absolute"), F.least(zero, F.coalesce(F.min("r"), zero)).alias("mae"), F.greatest(zero, F.coalesce(F.max("r"), zero)).alias("mfe"), F.count("r").alias("bars")
    )


@query("pl_outcome", f"WITH {OUTCOME_SQL} SELECT decision_id, {snap_sql('absolute')} AS absolute, {snap_sql('mae')} AS mae, {snap_sql('mfe')} AS mfe, bars FROM oc")
def pl_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).select("decision_id", *(snap(C(x)).alias(x) for x in ("absolute", "mae", "mfe")), "bars")


ATTRIBUTION_SQL = """at0 AS (SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 101 - 50) / 500::DOUBLE END AS absolute, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 61 - 30) / 500::DOUBLE END AS market,
 CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 71 - 35) / 500::DOUBLE END AS sector_excess, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 83 - 41) / 500::DOUBLE END AS theme_excess, CASE WHEN o_orderkey % 7 <> 0 THEN -(o_orderkey % 97) / 1000::DOUBLE END AS mae FROM orders), atr AS (SELECT *, absolute - market AS market_excess FROM at0)"""


def attribution_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    a = table(spark, sf, "orders").select(
        k.alias("decision_id"), F.when(k % 13 != 0, (k % 101 - 50) / 500.0).alias("absolute"), F.when(k % 17 != 0, (k % 61 - 30) / 500.0).alias("market"),
        F.when(k % 11 != 0, (k % 71 - 35) / 500.0).alias("sector_excess"), F.when(k % 5 != 0, (k % 83 - 41) / 500.0).alias("theme_excess"), F.when(k % 7 != 0, -(k % 97) / 1000.0).alias("mae"),
    )
    return a.withColumn("market_excess", C("absolute") - C("market"))


def verdicts() -> dict[str, Column]:
    """1 for correct, -1 for wrong, 0 for unknown, by what was judged."""
    sign = lambda x: F.when(x > 0.02, 1).when(x < -0.02, -1).otherwise(0)
    a, m, me, se, te, mae = (C(x) for x in ("absolute", "market", "market_excess", "sector_excess", "theme_excess", "mae"))
    return {
        "direction": sign(a),
        "market_regime": F.when((m > 0.02) & (a > 0), 1).when((m < -0.02) & (a < 0), -1).otherwise(0),
        "stock_selection": sign(me),
        "sector_selection": F.when((me > 0.02) & (se < -0.02), -1).otherwise(sign(se)),
        "theme_selection": sign(te),
        "entry_timing": F.when((mae <= -0.05) & (a - mae >= 0.03), -1).when(mae >= -0.01, 1).otherwise(0),
    }


_SGN = "CASE WHEN {0} > 0.02 THEN 1 WHEN {0} < -0.02 THEN -1 ELSE 0 END"
VERDICT_SQL = {
    "direction": _SGN.format("absolute"),
    "market_regime": "CASE WHEN market > 0.02 AND absolute > 0 THEN 1 WHEN market < -0.02 AND absolute < 0 THEN -1 ELSE 0 END",
    "stock_selection": _SGN.format("market_excess"),
    "sector_selection": f"CASE WHEN market_excess > 0.02 AND sector_excess < -0.02 THEN -1 ELSE {_SGN.format('sector_excess')} END",
    "theme_selection": _SGN.format("theme_excess"),
    "entry_timing": "CASE WHEN mae <= -0.05 AND absolute - mae >= 0.03 THEN -1 WHEN mae >= -0.01 THEN 1 ELSE 0 END",
}


def _listed(value: int) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {v} = {value} THEN '{k}' END" for k, v in VERDICT_SQL.items()) + ")"


def contributions() -> dict[str, Column]:
    """What market, theme or sector, stock and timing add to a return: the stock's is the excess over its sector, or over the
    market where no sector is known."""
    a, sector = C("absolute"), C("absolute") - C("sector_excess")
    return {"market_regime": C("market"), "theme_selection": F.coalesce("sector_excess", "theme_excess"), "stock_selection": a - F.coalesce(sector, C("market")), "timing": C("mae")}


CONTRIBUTION_SQL = {"market_regime": "market", "theme_selection": "coalesce(sector_excess, theme_excess)", "stock_selection": "absolute - coalesce(absolute - sector_excess, market)", "timing": "mae"}
_SIZES = " + ".join(f"abs(coalesce({c}, 0))" for c in CONTRIBUTION_SQL.values())


@query("sc_attribution", f"WITH {ATTRIBUTION_SQL} SELECT decision_id, {_listed(1)} AS correct, {_listed(-1)} AS wrong, {_listed(0)} AS unknown, " + ", ".join(f"{snap_sql(c)} AS {k}, CASE WHEN {_SIZES} > 0 THEN {snap_sql(f'abs({c}) / ({_SIZES})')} END AS {k}_share" for k, c in CONTRIBUTION_SQL.items()) + " FROM atr")
def sc_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Six dimensions judged, and the contributions with their shares of the sum of all sizes."""
    v = verdicts()
    listed = lambda k: F.concat_ws(",", *(F.when(c == k, name) for name, c in v.items()))
    a = attribution_rows(spark, sf).withColumn("part", F.struct(*(c.alias(k) for k, c in contributions().items())))
    size = sum((F.abs(F.coalesce(C(f"part.{k}"), F.lit(0.0))) for k in contributions()), F.lit(0.0))
    a = a.withColumn("size", size)
    shares = [x for k in contributions() for x in (snap(C(f"part.{k}")).alias(k), F.when(C("size") > 0, snap(F.abs(C(f"part.{k}")) / C("size"))).alias(f"{k}_share"))]
    return a.select("decision_id", listed(1).alias("correct"), listed(-1).alias("wrong"), listed(0).alias("unknown"), *shares)


_JUDGED = " + ".join(f"abs({v})" for v in VERDICT_SQL.values())


@query("sc_applicability", f"WITH {ATTRIBUTION_SQL} SELECT decision_id, round(({_JUDGED}) / 6, 6) AS applicability FROM atr")
def sc_applicability(spark: SparkSession, sf: str) -> DataFrame:
    """Share of what was judged either way."""
    v = verdicts()
    judged = sum((F.abs(c) for c in v.values()), F.lit(0))
    return attribution_rows(spark, sf).select("decision_id", F.round(judged / len(v), 6).alias("applicability"))


@query("pl_review", f"WITH {ATTRIBUTION_SQL} SELECT decision_id, {snap_sql('greatest(0.0, least(1.0, 0.5 + 5 * market_excess))')} AS quality, CASE WHEN market_excess > 0.02 THEN 'keep' WHEN market_excess < -0.02 THEN 'revise' ELSE 'watch' END AS lesson FROM atr WHERE market_excess IS NOT NULL")
def pl_review(spark: SparkSession, sf: str) -> DataFrame:
    a = attribution_rows(spark, sf).where("market_excess is not null")
    lesson = F.when(C("market_excess") > 0.02, "keep").when(C("market_excess") < -0.02, "revise").otherwise("watch")
    return a.select("decision_id", snap(S.clip(0.5 + 5 * C("market_excess"), 0, 1)).alias("quality"), lesson.alias("lesson"))


@query("sc_strategy_key", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'skill_' || event_type END, json_extract_string(props, '$.strategy'), 'k' || json_extract_string(props, '$.k'), 'unknown') AS strategy_key FROM events")
def sc_strategy_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.coalesce(F.when(C("event_id") % 3 == 0, F.concat(F.lit("skill_"), "event_type")), F.get_json_object("props", "$.strategy"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")), F.lit("unknown"))
    return table(spark, sf, "events").select("event_id", key.alias("strategy_key"))


@query("pl_replay", f"WITH {PORTFOLIO_SQL}, before AS (SELECT portfolio, symbol, target FROM t0), after AS (SELECT portfolio, symbol, target FROM t6) SELECT portfolio, count(*) FILTER (b.target IS DISTINCT FROM a.target) AS changed, count(*) AS n FROM before b FULL JOIN after a USING (portfolio, symbol) GROUP BY 1")
def pl_replay(spark: SparkSession, sf: str) -> DataFrame:
    """How many targets of a stored first pass a replay of the whole chain changes, by portfolio."""
    s = states(spark, sf)
    a = s.select("portfolio", "symbol", PF.first_target(C("score"), C("held")).alias("stored"))
    b = PF.actions(s).select("portfolio", "symbol", "target")
    both = a.join(b, ["portfolio", "symbol"], "full")
    return both.groupBy("portfolio").agg(F.sum((~C("stored").eqNullSafe(C("target"))).cast("long")).alias("changed"), F.count("*").alias("n"))


@query("fd_memory_expire", "SELECT doc_id AS memory_id, CASE WHEN source = 'src1' THEN 'regime' WHEN source = 'src2' THEN 'theme' ELSE 'fact' END AS kind, CASE WHEN source = 'src1' AND doc_id % 120 > 30 OR source = 'src2' AND doc_id % 120 > 90 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status FROM documents")
def fd_memory_expire(spark: SparkSession, sf: str) -> DataFrame:
    """Memories past the days their kind lives: 30 for regimes, 90 for themes, facts for ever."""
    age = C("doc_id") % 120
    kind = F.when(C("source") == "src1", "regime").when(C("source") == "src2", "theme").otherwise("fact")
    lives = F.when(kind == "regime", 30).when(kind == "theme", 90)
    return table(spark, sf, "documents").select(C("doc_id").alias("memory_id"), kind.alias("kind"), F.when(age > lives, "EXPIRED").otherwise("ACTIVE").alias("status"))


@query("fd_memory_merge", "WITH m AS (SELECT o_orderkey, o_custkey % 50 AS merge_key, o_orderdate, o_orderstatus AS fact, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS version, lag(o_orderstatus) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT merge_key, max(version) AS versions, arg_max(fact, version) AS fact, count(*) FILTER (before IS NOT NULL AND before <> fact) AS superseded FROM m GROUP BY 1")
def fd_memory_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates merged by key in the order of time: a differing fact supersedes the one before it."""
    w = Window.partitionBy("merge_key").orderBy("o_orderdate", "o_orderkey")
    m = table(spark, sf, "orders").select((C("o_custkey") % 50).alias("merge_key"), "o_orderdate", "o_orderkey", C("o_orderstatus").alias("fact"))
    m = m.withColumns({"version": F.row_number().over(w), "before": F.lag("fact").over(w)})
    return m.groupBy("merge_key").agg(F.max("version").cast("long").alias("versions"), F.max_by("fact", "version").alias("fact"), F.sum(F.when(C("before") != C("fact"), 1).otherwise(0)).alias("superseded"))


@query("fd_execution", "WITH q AS (SELECT event_id, user_id, ts, value FROM events), o AS (SELECT o_orderkey AS id, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 MINUTE * (o_orderkey % 20000) AS at FROM orders), f AS (SELECT id, arg_min(value, (ts, event_id)) AS price FROM o LEFT JOIN q ON q.user_id = o.user_id AND q.ts > o.at GROUP BY 1) SELECT id, round(price, 6) AS price, CASE WHEN price IS NULL THEN 'EXPIRED' ELSE 'FILLED' END AS status FROM f")
def fd_execution(spark: SparkSession, sf: str) -> DataFrame:
    """Paper fills: each order at the first quote after it, looked up backwards in time."""
    back = lambda c: -F.unix_micros(c.cast("timestamp"))
    o = table(spark, sf, "orders").select(C("o_orderkey").alias("id"), (C("o_custkey") % 150).alias("user_id"), F.expr("cast('2024-01-05 00:00:00' as timestamp_ntz) + make_dt_interval(0, 0, cast(o_orderkey % 20000 as int))").alias("at"))
    q = table(spark, sf, "events").select("user_id", back(C("ts")).alias("t"), (-C("event_id")).alias("e"), "value")
    out = as_of(o.withColumn("t0", back(C("at")) - 1), q, "user_id", "t0", "t", ["t", "e"], ["value"])
    return out.select("id", F.round("value", 6).alias("price"), F.when(C("value").isNull(), "EXPIRED").otherwise("FILLED").alias("status"))


@query("pl_decision_save", f"WITH {WINDOWS_SQL} SELECT decision_id, h AS horizon, strftime(entry + h::INT, '%Y-%m-%d') AS due, CASE WHEN h = 5 THEN true ELSE false END AS is_primary FROM dw, (VALUES (1), (5), (20)) v(h)")
def pl_decision_save(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation dates of every decision at each horizon; five days is the one that reviews wait for."""
    h = windows(spark, sf).select("decision_id", "entry", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))).alias("horizon"))
    return h.select("decision_id", "horizon", F.date_format(F.date_add("entry", C("horizon")), "yyyy-MM-dd").alias("due"), (C("horizon") == 5).alias("is_primary"))


@query("tk_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-06-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def tk_range(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where((C("o_orderdate") >= "1996-03-01") & (C("o_orderdate") < "1996-06-01"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", text_day("o_orderdate", "d"))


@query("tk_scores_daily", f"WITH {BARS_SQL}, s AS (SELECT d, symbol, amount, count(*) OVER (PARTITION BY d) AS n, row_number() OVER (PARTITION BY d ORDER BY amount DESC, symbol) AS k FROM bars) SELECT strftime(d, '%Y-%m-%d') AS d, symbol, k FROM s WHERE k <= greatest(5, n // 100)")
def tk_scores_daily(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("d")
    b = bars(spark, sf).select("d", "symbol", "amount", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("amount"), "symbol")).cast("long").alias("k"))
    return b.where(C("k") <= F.greatest(F.lit(5), F.floor(C("n") / 100))).select(text_day("d"), "symbol", "k")
