"""Scalar formulas over market days, candidates and raw texts: scores, regimes, parsing, price limits, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import parsing as P
from marlstone.functions import prices as X
from marlstone.functions import scores as S
from marlstone.operators.ordering import ranked
from marlstone.plans.market import DAY_SQL, day
from marlstone.registry import query
from marlstone.sources.tables import CANDIDATES_SQL, MARKET_SQL, candidates, market_days, table

C = F.col


def clip_sql(x: str, a: float = 0, b: float = 1) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({float(a)}, least({float(b)}, ({x}))) END"


# ---- market scores and regimes


def scored_days(spark: SparkSession, sf: str) -> DataFrame:
    """Market days with a theme strength and the six scores. Scores that need 20 days of history are null before that."""
    m = market_days(spark, sf).withColumn("theme", F.round(S.clip(50 + 100 * C("r1"), 0, 100), 6))
    m = m.withColumn("breadth", S.breadth(C("up"), C("down"))).withColumn("trend", S.trend(C("r5"), C("r20")))
    return m.withColumns(
        {
            "crowding": S.crowding(C("theme"), C("limit_up")),
            "rotation": S.rotation(C("theme"), C("breadth")),
            "range": S.range_bound(C("volatility"), C("breadth")),
            "drawdown_risk": S.drawdown_risk(C("drawdown"), C("limit_down")),
            "retreat": S.retreat(C("down") / C("n"), C("limit_down") / C("n"), C("limit_down") / C("n"), C("big_negative").cast("double")),
        }
    )


SCORED_SQL = f"""{MARKET_SQL}, sc0 AS (
  SELECT *, round({clip_sql('50 + 100 * r1', 0, 100)}, 6) AS theme, round(round(CASE WHEN up + down > 0 THEN up / (up + down) ELSE 0.5 END, 9), 4) AS breadth FROM market
), scored AS (
  SELECT *, round(round({clip_sql('0.5 + 2 * r5 + r20')}, 9), 4) AS trend,
    round(round({clip_sql('0.7 * theme / 100 + 0.3 * least(limit_up / 50, 1.0)')}, 9), 4) AS crowding,
    round(round({clip_sql('1 - abs(theme / 100 - breadth)')}, 9), 4) AS rotation,
    round(round({clip_sql('0.5 * CASE WHEN volatility IS NOT NULL THEN greatest(0.0, 1 - 10 * abs(volatility - 0.02)) END + 0.5 * greatest(0.0, 1 - 2 * abs(breadth - 0.5))')}, 9), 4) AS range,
    round(round({clip_sql('0.7 * least(4 * abs(drawdown), 1.0) + 0.3 * least(limit_down / 30, 1.0)')}, 9), 4) AS drawdown_risk,
    round(round({clip_sql('0.35 * (down / n) + 0.25 * (limit_down / n) + 0.25 * (limit_down / n) + 0.15 * least(big_negative / 10, 1.0)')}, 9), 4) AS retreat
  FROM sc0
)"""


@query("sc_market_scores", f"WITH {SCORED_SQL} SELECT {DAY_SQL}, breadth, trend, crowding, rotation, range, drawdown_risk, retreat, coalesce(retreat >= 0.65, false) AS retreating FROM scored")
def sc_market_scores(spark: SparkSession, sf: str) -> DataFrame:
    names = ("breadth", "trend", "crowding", "rotation", "range", "drawdown_risk", "retreat")
    return scored_days(spark, sf).select(day(), *names, F.coalesce(C("retreat") >= S.RETREAT_LEVEL, F.lit(False)).alias("retreating"))


@query("sc_classify_snapshot", f"WITH {MARKET_SQL} SELECT {DAY_SQL}, CASE WHEN r20 * 100 >= 5 AND r5 * 100 >= 1 AND r1 * 100 >= 0 THEN 'strong_up' WHEN r20 * 100 >= 2 AND r5 * 100 >= 0 THEN 'mild_up' WHEN r20 * 100 <= -4 AND r5 * 100 <= -1 THEN 'weak' WHEN r5 < 0 OR r1 < 0 THEN 'mild_down' ELSE 'flat' END AS label FROM market")
def sc_classify_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return market_days(spark, sf).select(day(), S.snapshot_label(C("r1") * 100, C("r5") * 100, C("r20") * 100).alias("label"))


def inputs() -> dict[str, Column]:
    """Regime inputs of ``scored_days``; the range score is missing on the days when few symbols trade."""
    return {"retreat": C("retreat"), "drawdown": C("drawdown_risk"), "breadth": C("breadth"), "crowding": C("crowding"), "range": F.when(C("n") >= 12, C("range")), "rotation": C("rotation")}


_IN = "retreat, drawdown_risk AS drawdown, breadth, crowding, CASE WHEN n >= 12 THEN range END AS range, rotation"
REGIME_SQL = f"""{SCORED_SQL}, ri AS (SELECT d, n, r1, {_IN} FROM scored), rm AS (
  SELECT *, 0.02 + coalesce({clip_sql('(retreat - 0.40) / 0.30')}, 0) AS m1,
    0.02 + 0.6 * coalesce({clip_sql('(drawdown - 0.40) / 0.30')}, 0) + 0.4 * coalesce(1 - {clip_sql('(breadth - 0.25) / 0.25')}, 0) AS m2,
    0.02 + coalesce({clip_sql('(crowding - 0.57) / 0.25')}, 0) AS m3,
    0.02 + 0.5 * coalesce(least({clip_sql('(breadth - 0.25) / 0.10')}, 1 - {clip_sql('(breadth - 0.60) / 0.10')}), 0) + 0.5 * coalesce(range, 0) AS m4,
    0.02 + 0.55 * coalesce(rotation, 0) + 0.45 * coalesce({clip_sql('(breadth - 0.35) / 0.25')}, 0) AS m5,
    ((retreat IS NULL)::INT + (drawdown IS NULL)::INT + 3 * (breadth IS NULL)::INT + (crowding IS NULL)::INT + (range IS NULL)::INT + (rotation IS NULL)::INT) / 8 AS u
  FROM ri
), rp AS (
  SELECT *, round(round(m1 / (m1+m2+m3+m4+m5+u), 9), 4) AS p1, round(round(m2 / (m1+m2+m3+m4+m5+u), 9), 4) AS p2, round(round(m3 / (m1+m2+m3+m4+m5+u), 9), 4) AS p3,
    round(round(m4 / (m1+m2+m3+m4+m5+u), 9), 4) AS p4, round(round(m5 / (m1+m2+m3+m4+m5+u), 9), 4) AS p5, round(round(u / (m1+m2+m3+m4+m5+u), 9), 4) AS p6 FROM rm
)"""
RULE_SQL = """CASE WHEN retreat IS NULL OR drawdown IS NULL OR breadth IS NULL OR crowding IS NULL THEN 'UNKNOWN' WHEN retreat >= 0.65 THEN 'high_position_retreat'
 WHEN drawdown >= 0.6 AND breadth <= 0.35 THEN 'downtrend' WHEN crowding >= 0.72 THEN 'crowding' WHEN breadth BETWEEN 0.35 AND 0.6 THEN 'range' ELSE 'rotation' END"""
ARGMAX_SQL = """CASE greatest(p1, p2, p3, p4, p5, p6) WHEN p1 THEN 'high_position_retreat' WHEN p2 THEN 'downtrend' WHEN p3 THEN 'crowding' WHEN p4 THEN 'range' WHEN p5 THEN 'rotation' ELSE 'UNKNOWN' END"""


@query("sc_regime_rule", f"WITH {REGIME_SQL} SELECT {DAY_SQL}, {RULE_SQL} AS regime, round(greatest(coalesce(crowding, 0), coalesce(1 - drawdown, 0), 0.55), 6) AS confidence FROM ri")
def sc_regime_rule(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0.0)
    confidence = F.greatest(F.coalesce("crowding", zero), F.coalesce(1 - C("drawdown_risk"), zero), F.lit(0.55))
    return scored_days(spark, sf).select(day(), S.regime_rule(inputs()).alias("regime"), F.round(confidence, 6).alias("confidence"))


@query("sc_regime_prob", f"WITH {REGIME_SQL} SELECT {DAY_SQL}, p1, p2, p3, p4, p5, p6, {ARGMAX_SQL} AS regime, greatest(p1, p2, p3, p4, p5, p6) AS confidence FROM rp")
def sc_regime_prob(spark: SparkSession, sf: str) -> DataFrame:
    p = S.regime_probabilities(inputs())
    named = scored_days(spark, sf).select("d", *(c.alias(f"p{k}") for k, c in enumerate(p.values(), 1)))
    best = S.most_likely({name: C(f"p{k}") for k, name in enumerate(p, 1)})
    return named.select(day(), *(f"p{k}" for k in range(1, 7)), best["name"].alias("regime"), best["p"].alias("confidence"))


_B = ", ".join(f"0.75 * p{k} + 0.25 * {h} AS b{k}" for k, h in ((1, "0"), (2, "(CASE WHEN r1 < 0 THEN 0.7 ELSE 0.1 END)"), (3, "0"), (4, "0"), (5, "(CASE WHEN r1 < 0 THEN 0.3 ELSE 0.9 END)"), (6, "0")))
_TOTAL = "(b1+b2+b3+b4+b5+b6)"


@query("sc_regime_blend", f"WITH {REGIME_SQL}, bl AS (SELECT d, {_B} FROM rp) SELECT {DAY_SQL}, " + ", ".join(f"floor(b{k} / {_TOTAL} * 10000 + 0.5 + 1e-6) / 10000 AS p{k}" for k in range(1, 7)) + " FROM bl")
def sc_regime_blend(spark: SparkSession, sf: str) -> DataFrame:
    p = S.regime_probabilities(inputs())
    days = scored_days(spark, sf).select("d", "r1", *(c.alias(k) for k, c in p.items()))
    falls = C("r1") < 0
    hint = {"downtrend": F.when(falls, 0.7).otherwise(0.1), "rotation": F.when(falls, 0.3).otherwise(0.9)}
    mixed = S.blend({k: C(k) for k in p}, hint)
    return days.select(day(), *(c.alias(f"p{k}") for k, c in enumerate(mixed.values(), 1)))


@query("sc_regime_v2", f"WITH {REGIME_SQL} SELECT {DAY_SQL}, {ARGMAX_SQL} AS regime, round(greatest(p1, p2, p3, p4, p5, p6) * CASE WHEN n < 12 THEN 0.5 ELSE 1 END, 6) AS confidence, CASE WHEN n < 12 THEN 'low' ELSE 'ok' END AS quality, list_sort(list_filter([CASE WHEN range IS NULL THEN 'range' END, CASE WHEN drawdown IS NULL THEN 'drawdown' END], lambda x: x IS NOT NULL)).array_to_string(',') AS missing FROM rp")
def sc_regime_v2(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs()
    p = S.regime_probabilities(s)
    best = S.most_likely(p)
    low = C("n") < 12
    days = scored_days(spark, sf).select("d", "n", best.alias("best"), S.codes({"range": s["range"].isNull(), "drawdown": s["drawdown"].isNull()}).alias("missing"))
    return days.select(day(), C("best.name").alias("regime"), F.round(C("best.p") * F.when(low, 0.5).otherwise(1.0), 6).alias("confidence"), F.when(low, "low").otherwise("ok").alias("quality"), F.array_join("missing", ",").alias("missing"))


@query("sc_quality_gate", f"""WITH {MARKET_SQL}, q AS (SELECT d, n / 100.0 AS cover, r20 IS NOT NULL AS has_index, (n % 10) / 10.0 AS member, up + down > 0 AS has_limit FROM market),
 f AS (SELECT *, CASE WHEN cover >= 0.9 THEN 0 WHEN cover >= 0.7 THEN 1 ELSE 2 END AS a, CASE WHEN has_index THEN 0 ELSE 2 END AS b, CASE WHEN member >= 0.8 THEN 0 WHEN member >= 0.6 THEN 1 ELSE 2 END AS c, CASE WHEN has_limit THEN 0 ELSE 1 END AS e FROM q)
 SELECT {DAY_SQL}, CASE greatest(a, b, c, e) WHEN 0 THEN 'OK' WHEN 1 THEN 'DEGRADED' ELSE 'INSUFFICIENT' END AS status, round(round(((a = 0)::INT + (b = 0)::INT + (c = 0)::INT + (e = 0)::INT) / 4, 9), 4) AS score,
 array_to_string(list_filter([CASE WHEN b > 0 THEN 'INDEX_MISSING' END, CASE WHEN e > 0 THEN 'LIMIT_METADATA_MISSING' END, CASE WHEN c > 0 THEN 'MEMBERSHIP_COVERAGE_LOW' END, CASE WHEN a > 0 THEN 'QUOTE_COVERAGE_LOW' END], lambda x: x IS NOT NULL), ',') AS flags FROM f""")
def sc_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = market_days(spark, sf)
    cover, member = C("n") / 100.0, (C("n") % 10) / 10.0
    level = {
        "QUOTE_COVERAGE_LOW": F.when(cover >= 0.9, 0).when(cover >= 0.7, 1).otherwise(2),
        "INDEX_MISSING": F.when(C("r20").isNotNull(), 0).otherwise(2),
        "MEMBERSHIP_COVERAGE_LOW": F.when(member >= 0.8, 0).when(member >= 0.6, 1).otherwise(2),
        "LIMIT_METADATA_MISSING": F.when(C("up") + C("down") > 0, 0).otherwise(1),
    }
    worst = F.greatest(*level.values())
    passed = sum((F.when(c == 0, 1).otherwise(0) for c in level.values()), F.lit(0))
    status = F.when(worst == 0, "OK").when(worst == 1, "DEGRADED").otherwise("INSUFFICIENT")
    return m.select(day(), status.alias("status"), F.round(passed / 4, 4).alias("score"), F.array_join(S.codes({k: c > 0 for k, c in level.items()}), ",").alias("flags"))


# ---- candidates


def _scores(*names: str) -> dict[str, Column]:
    return {k: C(k) for k in names}


_OPP = " + ".join(f"{w} * coalesce({k}, 50.0)" for w, k in S.OPPORTUNITY)


@query("sc_opportunity_score", f"WITH {CANDIDATES_SQL} SELECT symbol, round(round({clip_sql(_OPP, 0, 100)}, 9), 4) AS score, (theme_score IS NULL)::BIGINT + (technical_score IS NULL)::BIGINT + (factor_score IS NULL)::BIGINT + (regime_fit_score IS NULL)::BIGINT + (knowledge_score IS NULL)::BIGINT + (risk_score IS NULL)::BIGINT AS n_missing FROM cand")
def sc_opportunity_score(spark: SparkSession, sf: str) -> DataFrame:
    names = [k for _, k in S.OPPORTUNITY]
    missing = sum((C(k).isNull().cast("long") for k in names), F.lit(0).cast("long"))
    return candidates(spark, sf).select("symbol", S.opportunity_score(_scores(*names)).alias("score"), missing.alias("n_missing"))


def rejections() -> Column:
    return S.codes(
        {
            "QUOTE_MISSING": ~C("quote_available"),
            "SUSPENDED": C("suspended"),
            "LIQUIDITY_TOO_LOW": C("liquidity_score") < 20,
            "DATA_COVERAGE_LOW": C("data_coverage") < 0.6,
            "THEME_INVALIDATED": C("theme_score") < 5,
            "TECHNICAL_INVALIDATED": C("technical_score") < 5,
            "RISK_LIMIT_EXCEEDED": C("risk_score") > 95,
        }
    )


REJECT_SQL = """array_to_string(list_filter([CASE WHEN data_coverage < 0.6 THEN 'DATA_COVERAGE_LOW' END, CASE WHEN liquidity_score < 20 THEN 'LIQUIDITY_TOO_LOW' END,
 CASE WHEN NOT quote_available THEN 'QUOTE_MISSING' END, CASE WHEN risk_score > 95 THEN 'RISK_LIMIT_EXCEEDED' END, CASE WHEN suspended THEN 'SUSPENDED' END,
 CASE WHEN technical_score < 5 THEN 'TECHNICAL_INVALIDATED' END, CASE WHEN theme_score < 5 THEN 'THEME_INVALIDATED' END], lambda x: x IS NOT NULL), ',')"""


@query("pr_eligibility", f"WITH {CANDIDATES_SQL}, r AS (SELECT symbol, {REJECT_SQL} AS reasons FROM cand) SELECT symbol, reasons, reasons = '' AS eligible FROM r")
def pr_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    r = rejections()
    return candidates(spark, sf).select("symbol", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("eligible"))


_TH = "0.25 * coalesce(technical_score, 0) + 0.15 * coalesce(liquidity_score, 0) + 0.15 * coalesce(factor_score, 0) + 0.20 * coalesce(theme_score, 0) + 0.15 * coalesce(technical_score, 0) + 0.10 * coalesce(knowledge_score, 0) - 0.20 * coalesce(risk_score, 0)"


@query("sc_theme_score", f"WITH {CANDIDATES_SQL} SELECT symbol, round({clip_sql(_TH, 0, 100)}, 2) AS score, concat_ws(';', CASE WHEN technical_score >= 60 THEN 'price strong' END, CASE WHEN theme_score >= 60 THEN 'news active' END, CASE WHEN risk_score >= 60 THEN 'risk high' END) AS reasons FROM cand")
def sc_theme_score(spark: SparkSession, sf: str) -> DataFrame:
    x = {"price": C("technical_score"), "volume": C("liquidity_score"), "flow": C("factor_score"), "news": C("theme_score"), "technical": C("technical_score"), "knowledge": C("knowledge_score"), "risk": C("risk_score")}
    reasons = F.concat_ws(";", F.when(x["price"] >= 60, "price strong"), F.when(x["news"] >= 60, "news active"), F.when(x["risk"] >= 60, "risk high"))
    return candidates(spark, sf).select("symbol", S.theme_score(x).alias("score"), reasons.alias("reasons"))


_REGIME_OF = "CASE symbol % 4 WHEN 0 THEN 'rotation' WHEN 1 THEN 'high_position_retreat' WHEN 2 THEN 'downtrend' ELSE 'range' END"


@query("sc_adjust_signal", f"WITH {CANDIDATES_SQL}, a AS (SELECT symbol, {_REGIME_OF} AS regime, coalesce(technical_score, 0) AS raw, theme_score AS theme, coalesce(liquidity_score >= 20, false) AS liquid FROM cand), b AS (SELECT symbol, greatest(0.0, least(100.0, raw + CASE regime WHEN 'rotation' THEN CASE WHEN raw <= 80 THEN 5.0 ELSE -5.0 END WHEN 'high_position_retreat' THEN -12.0 WHEN 'downtrend' THEN -18.0 ELSE 0.0 END + CASE WHEN theme >= 75 THEN 5.0 WHEN theme <= 45 THEN -5.0 ELSE 0.0 END + CASE WHEN liquid THEN 0.0 ELSE -10.0 END)) AS score FROM a) SELECT symbol, score::DOUBLE AS score, score >= 70 AS selected FROM b")
def sc_adjust_signal(spark: SparkSession, sf: str) -> DataFrame:
    k = C("symbol") % 4
    regime = F.when(k == 0, "rotation").when(k == 1, "high_position_retreat").when(k == 2, "downtrend").otherwise("range")
    score = S.adjusted_signal(F.coalesce("technical_score", F.lit(0.0)), regime, C("theme_score"), F.coalesce(C("liquidity_score") >= 20, F.lit(False)))
    return candidates(spark, sf).select("symbol", score.alias("score")).select("symbol", "score", (C("score") >= 70).alias("selected"))


#: Weights of strategies by regime.
ROUTES = {"rotation": {"momentum": 0.30, "reversal": 0.10}, "downtrend": {"defensive": 0.25}, "range": {"reversal": 0.25, "momentum": 0.05}}


@query("sc_score_signal", f"WITH {CANDIDATES_SQL}, r(regime, strategy, weight) AS (VALUES " + ", ".join(f"('{r}', '{s}', {w}::DOUBLE)" for r, own in ROUTES.items() for s, w in own.items()) + f"), a AS (SELECT symbol, {_REGIME_OF} AS regime, CASE symbol % 3 WHEN 0 THEN 'momentum' WHEN 1 THEN 'reversal' ELSE 'defensive' END AS strategy, technical_score AS base FROM cand) SELECT symbol, round(CASE WHEN base IS NOT NULL THEN greatest(0.0, least(100.0, base * (0.7 + coalesce(weight, 0.05)))) END, 6) AS score FROM a LEFT JOIN r USING (regime, strategy)")
def sc_score_signal(spark: SparkSession, sf: str) -> DataFrame:
    k, j = C("symbol") % 4, C("symbol") % 3
    c = candidates(spark, sf).select(
        "symbol", "technical_score",
        F.when(k == 0, "rotation").when(k == 1, "high_position_retreat").when(k == 2, "downtrend").otherwise("range").alias("regime"),
        F.when(j == 0, "momentum").when(j == 1, "reversal").otherwise("defensive").alias("strategy"),
    )
    routes = spark.createDataFrame([(r, s, w) for r, own in ROUTES.items() for s, w in own.items()], "regime string, strategy string, weight double")
    return c.join(F.broadcast(routes), ["regime", "strategy"], "left").select("symbol", F.round(S.signal_score(C("technical_score"), C("weight")), 6).alias("score"))


@query("sc_conflict_action", f"WITH {CANDIDATES_SQL} SELECT symbol, CASE WHEN NOT quote_available OR suspended THEN 'wait' WHEN technical_score >= 70 AND (risk_score IS NULL OR risk_score < 60) THEN 'candidate_buy' ELSE 'observe' END AS action FROM cand")
def sc_conflict_action(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(~C("quote_available") | C("suspended"), "wait").when((C("technical_score") >= 70) & (C("risk_score").isNull() | (C("risk_score") < 60)), "candidate_buy").otherwise("observe")
    return candidates(spark, sf).select("symbol", action.alias("action"))


@query("sc_explanation_score", f"WITH {CANDIDATES_SQL} SELECT symbol, round(greatest(0.0, least(100.0, 40.0 + 10 * (symbol % 5) + 10 * (symbol % 3) + CASE WHEN suspended THEN 0 ELSE 20 END)), 6)::DOUBLE AS score FROM cand")
def sc_explanation_score(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence and risks count ten each, a stated invalidation twenty, over a base of forty."""
    return candidates(spark, sf).select("symbol", F.round(S.clip(40.0 + 10 * (C("symbol") % 5) + 10 * (C("symbol") % 3) + F.when(C("suspended"), 0).otherwise(20), 0, 100), 6).alias("score"))


_REFS = "list_filter([CASE WHEN theme_score IS NOT NULL THEN 'theme:' || theme END, CASE WHEN technical_score IS NOT NULL THEN 'technical' END, CASE WHEN factor_score IS NOT NULL THEN 'factor' END, CASE WHEN knowledge_score IS NOT NULL THEN 'knowledge' END, 'ev' || (symbol % 7)::VARCHAR], lambda x: x IS NOT NULL)"


@query("sc_evidence_refs", f"WITH {CANDIDATES_SQL} SELECT symbol, array_to_string({_REFS}, '|') AS refs FROM cand")
def sc_evidence_refs(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.when(C("theme_score").isNotNull(), F.concat(F.lit("theme:"), C("theme")))] + [F.when(C(f"{k}_score").isNotNull(), k) for k in ("technical", "factor", "knowledge")]
    refs = F.concat(F.array_compact(F.array(*parts)), F.array(F.concat(F.lit("ev"), (C("symbol") % 7).cast("string"))))
    return candidates(spark, sf).select("symbol", F.array_join(refs, "|").alias("refs"))


def live_returns(events: DataFrame) -> DataFrame:
    """(symbol, return_5m): values are added in the order of event ids, as the rounding shows in which order doubles are summed;
    so the result doesn't depend on how the table is cut into tasks."""
    rows = events.select(C("user_id").alias("symbol"), "event_id", "value").repartition("symbol").sortWithinPartitions("symbol", "event_id")
    return rows.groupBy("symbol").agg(F.round(F.sum("value") / F.count("*") / 1000, 6).alias("return_5m"))


@query("sc_realtime_overlay", f"WITH {CANDIDATES_SQL}, live AS (SELECT user_id AS symbol, round(sum(value) / count(*) / 1000, 6) AS return_5m FROM events GROUP BY user_id), t AS (SELECT symbol, round(round({clip_sql('technical_score + coalesce(return_5m, 0) * 100', 0, 100)}, 9), 4) AS technical FROM cand LEFT JOIN live USING (symbol)) SELECT symbol, technical, row_number() OVER (ORDER BY technical DESC NULLS LAST, symbol) AS rank FROM t")
def sc_realtime_overlay(spark: SparkSession, sf: str) -> DataFrame:
    t = candidates(spark, sf).join(live_returns(table(spark, sf, "events")), "symbol", "left").select("symbol", S.r4(S.clip(C("technical_score") + F.coalesce("return_5m", F.lit(0.0)) * 100, 0, 100)).alias("technical"))
    return ranked(t, F.desc_nulls_last("technical"), C("symbol"))


# ---- parsing


@query("sc_safe_float", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN ' 1,234.5 ' WHEN 4 THEN '12.5%' WHEN 5 THEN '-3' ELSE o_shippriority_free END AS x FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '.25' AS o_shippriority_free FROM orders))
 SELECT o_orderkey, coalesce(TRY_CAST(trim(regexp_replace(x, '[,%]', '', 'g')) AS DOUBLE), 0.0) AS safe, TRY_CAST(trim(regexp_replace(x, '[,%]', '', 'g')) AS DOUBLE) AS optional FROM t""")
def sc_safe_float(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey") % 7
    x = F.when(k == 0, None).when(k == 1, "").when(k == 2, "n/a").when(k == 3, " 1,234.5 ").when(k == 4, "12.5%").when(k == 5, "-3").otherwise(F.concat(C("o_orderkey").cast("string"), F.lit(".25")))
    return table(spark, sf, "orders").select("o_orderkey", P.safe_float(x).alias("safe"), P.optional_float(x).alias("optional"))


@query("sc_optional_bool", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM orders")
def sc_optional_bool(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey") % 5
    return table(spark, sf, "orders").select("o_orderkey", P.optional_bool(F.when(k == 0, " TRUE ").when(k == 1, "0").when(k == 2, "yes").when(k == 3, "N").otherwise("maybe")).alias("flag"))


@query("sc_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def sc_parse_date(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(P.parse_date(text), "yyyy-MM-dd").alias("d"))


@query("sc_symbol_norm", "WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '60' WHEN 1 THEN '00' WHEN 2 THEN '30' WHEN 3 THEN '83' WHEN 4 THEN '92' ELSE '43' END || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS code FROM part) SELECT p_partkey, code || CASE WHEN code[1] = '6' THEN '.SH' WHEN code[1] IN ('0', '3') THEN '.SZ' ELSE '.BJ' END AS symbol FROM t")
def sc_symbol_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", P.exchange_symbol(part_code()).alias("symbol"))


def part_code() -> Column:
    k = C("p_partkey") % 6
    head = F.when(k == 0, "60").when(k == 1, "00").when(k == 2, "30").when(k == 3, "83").when(k == 4, "92").otherwise("43")
    return F.concat(head, F.lpad((C("p_partkey") % 10000).cast("string"), 4, "0"))


@query("sc_period_adjust_norm", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1d' WHEN 1 THEN '1w' ELSE '5m' END AS period, CASE o_orderkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'none' END AS adjust FROM orders")
def sc_period_adjust_norm(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey") % 3
    freq = F.when(k == 0, "Daily").when(k == 1, " week ").otherwise("5m")
    adjust = F.when(k == 0, "qfq").when(k == 1, "HFQ")
    return table(spark, sf, "orders").select("o_orderkey", P.period_name(freq).alias("period"), P.adjust_name(adjust).alias("adjust"))


@query("sc_first_present", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END AS name, coalesce(contains(upper(p_name), 'ST'), false) AS special FROM part")
def sc_first_present(spark: SparkSession, sf: str) -> DataFrame:
    k = C("p_partkey") % 3
    name = P.first_present(F.when(k == 0, C("p_name")).when(k == 1, " "), F.when(k == 1, C("p_brand")), C("p_type"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), P.is_special_treatment(C("p_name")).alias("special"))


@query("sc_parse_price", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'INVALID' ELSE 'VALID' END AS status, CASE WHEN p_partkey % 5 = 4 THEN p_retailprice END AS value FROM part")
def sc_parse_price(spark: SparkSession, sf: str) -> DataFrame:
    k = C("p_partkey") % 5
    text = F.when(k == 1, " ").when(k == 2, "abc").when(k == 3, "-1").when(k == 4, C("p_retailprice").cast("string"))
    p = P.parse_price(text)
    return table(spark, sf, "part").select("p_partkey", p["status"].alias("status"), p["value"].alias("value"))


@query("sc_inspect_limit_meta", "SELECT p_partkey, p_partkey % 3 = 0 AS has_upper, p_partkey % 4 = 0 AS has_lower, p_partkey % 3 = 0 AND p_partkey % 4 = 0 AS has_both, p_partkey % 6 = 0 AS bad_upper, p_partkey % 3 = 0 AND p_partkey % 4 = 0 AND p_partkey % 24 = 0 AS crossed FROM part")
def sc_inspect_limit_meta(spark: SparkSession, sf: str) -> DataFrame:
    k = C("p_partkey")
    upper = P.parse_price(F.when(k % 3 == 0, F.when(k % 24 == 0, "1").otherwise("20")).when(k % 6 == 0, "x"))
    lower = P.parse_price(F.when(k % 4 == 0, "10"))
    good_u, good_l = upper["status"] == "VALID", lower["status"] == "VALID"
    return table(spark, sf, "part").select("p_partkey", good_u.alias("has_upper"), good_l.alias("has_lower"), (good_u & good_l).alias("has_both"), (k % 6 == 0).alias("bad_upper"), F.coalesce(upper["value"] < lower["value"], F.lit(False)).alias("crossed"))


@query("sc_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7, 2) AS rounded, greatest(10.0, least(40.0, l_quantity)) AS clamped, CASE WHEN l_tax > 0 THEN round(greatest(0.0, least(1.0, l_discount / l_tax)), 6) END AS ratio FROM lineitem")
def sc_round(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(C("l_extendedprice") / 7, 2).alias("rounded"), S.clip(C("l_quantity"), 10, 40).alias("clamped"), S.ratio(C("l_discount"), C("l_tax")).alias("ratio"))


# ---- price limits and costs

_BOARD = "CASE WHEN code LIKE '688%' THEN 'star' WHEN code LIKE '300%' OR code LIKE '301%' THEN 'growth' WHEN code LIKE '920%' OR code LIKE '8%' OR code LIKE '4%' THEN 'north' ELSE 'main' END"
LIMIT_SQL = f"""lc AS (SELECT p_partkey, p_retailprice, CASE p_partkey % 7 WHEN 0 THEN '688' WHEN 1 THEN '300' WHEN 2 THEN '920' WHEN 3 THEN '830' ELSE '600' END || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS code,
  p_partkey % 5 = 0 AS special, CASE WHEN p_partkey % 2 = 0 THEN DATE '2026-07-05' ELSE DATE '2026-07-06' END AS day,
  CASE p_partkey % 11 WHEN 0 THEN 15.0 WHEN 1 THEN 0.08 WHEN 2 THEN 0.0 END AS quoted, p_partkey % 13 = 0 AS unlimited FROM part),
 lb AS (SELECT *, {_BOARD} AS board FROM lc),
 lr AS (SELECT *, CASE WHEN NOT unlimited THEN coalesce(CASE WHEN quoted > 1 THEN quoted / 100 WHEN quoted > 0 THEN quoted END, CASE WHEN board IN ('star', 'growth') THEN 0.20 WHEN board = 'north' THEN 0.30 WHEN special AND day < DATE '2026-07-06' THEN 0.05 ELSE 0.10 END)::DOUBLE END AS rate FROM lb)"""


def limit_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = C("p_partkey")
    j = k % 7
    head = F.when(j == 0, "688").when(j == 1, "300").when(j == 2, "920").when(j == 3, "830").otherwise("600")
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_retailprice", F.concat(head, F.lpad((k % 1000).cast("string"), 3, "0")).alias("code"), (k % 5 == 0).alias("special"),
        F.when(k % 2 == 0, F.lit("2026-07-05").cast("date")).otherwise(F.lit("2026-07-06").cast("date")).alias("day"),
        F.when(k % 11 == 0, 15.0).when(k % 11 == 1, 0.08).when(k % 11 == 2, 0.0).alias("quoted"), (k % 13 == 0).alias("unlimited"),
    )
    rows = rows.withColumn("board", X.board(C("code")))
    return rows.withColumn("rate", X.limit_rate(C("board"), C("special"), C("day"), C("quoted"), C("unlimited")))


@query("sc_limit_rule", f"WITH {LIMIT_SQL} SELECT p_partkey, board, rate FROM lr")
def sc_limit_rule(spark: SparkSession, sf: str) -> DataFrame:
    return limit_rows(spark, sf).select("p_partkey", "board", "rate")


@query("sc_limit_price", f"WITH {LIMIT_SQL} SELECT p_partkey, CASE WHEN rate IS NULL THEN NULL ELSE round(floor((p_retailprice * (1 + rate)) * 100 + 0.5 + 1e-7) / 100, 2) END AS upper, CASE WHEN rate IS NULL THEN NULL ELSE round(floor((p_retailprice * (1 - rate)) * 100 + 0.5 + 1e-7) / 100, 2) END AS lower FROM lr")
def sc_limit_price(spark: SparkSession, sf: str) -> DataFrame:
    up, down = X.limit_prices(C("p_retailprice"), C("rate"), F.lit(0.01))
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    return limit_rows(spark, sf).select("p_partkey", finite(up).alias("upper"), finite(down).alias("lower"))


@query("pr_can_trade", f"WITH {LIMIT_SQL}, q AS (SELECT p_partkey, rate, p_retailprice, floor(p_retailprice * (1 + (p_partkey % 41 - 20) / 100::DOUBLE) * 100 + 0.5 + 1e-7) / 100 AS px, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey % 19)::DOUBLE END AS volume FROM lr) SELECT p_partkey, coalesce(volume, 0) <= 0 AS suspended, rate IS NULL OR px < round(floor((p_retailprice * (1 + rate)) * 100 + 0.5 + 1e-7) / 100, 2) AS can_buy, rate IS NULL OR px > round(floor((p_retailprice * (1 - rate)) * 100 + 0.5 + 1e-7) / 100, 2) AS can_sell FROM q")
def pr_can_trade(spark: SparkSession, sf: str) -> DataFrame:
    k = C("p_partkey")
    px = F.round(F.round(C("p_retailprice") * (1 + (k % 41 - 20) / 100.0), 9), 2)
    up, down = X.limit_prices(C("p_retailprice"), C("rate"), F.lit(0.01))
    volume = F.when(k % 17 != 0, (k % 19).cast("double"))
    return limit_rows(spark, sf).select("p_partkey", X.suspended(volume).alias("suspended"), X.can_buy(px, up).alias("can_buy"), X.can_sell(px, down).alias("can_sell"))


@query("sc_trade_cost", "SELECT o_orderkey, round(greatest(o_totalprice * 0.00025, 5.0) + CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.0005 ELSE 0.0 END + o_totalprice * 0.001, 8) AS cost FROM orders")
def sc_trade_cost(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(X.trade_cost(C("o_totalprice"), C("o_orderkey") % 2 == 0), 8).alias("cost"))


@query("sc_tick_size", "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 > 0 THEN p_size % 4 / 100.0 END, CASE WHEN p_partkey % 3 = 1 THEN 0.005 END, 0.01)::DOUBLE AS tick FROM part")
def sc_tick_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.tick_size((C("p_size") % 4) / 100.0, F.when(C("p_partkey") % 3 == 1, 0.005).otherwise(-1.0)).alias("tick"))


@query("sc_statutory_deadline", "WITH t AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS p FROM orders) SELECT strftime(p, '%Y-%m-%d') AS period_end, CASE strftime(p, '%m') WHEN '03' THEN year(p)::VARCHAR || '-04-30' WHEN '06' THEN year(p)::VARCHAR || '-08-31' WHEN '09' THEN year(p)::VARCHAR || '-10-31' WHEN '12' THEN (year(p) + 1)::VARCHAR || '-04-30' ELSE strftime(p + INTERVAL 4 MONTH, '%Y-%m-%d') END AS deadline FROM t")
def sc_statutory_deadline(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select(F.last_day(F.to_date("o_orderdate")).alias("p")).distinct()
    return t.select(F.date_format("p", "yyyy-MM-dd").alias("period_end"), F.date_format(P.statutory_deadline(C("p")), "yyyy-MM-dd").alias("deadline"))


@query("sc_event_match", "SELECT doc_id, least(100, 15 * ((contains(lower(coalesce(text, '')), 'the'))::INT + (contains(lower(coalesce(text, '')), 'und'))::INT + (contains(lower(coalesce(text, '')), 'que'))::INT) + 20 * (contains(lower(coalesce(text, '')), 'license'))::INT)::BIGINT AS score FROM documents")
def sc_event_match(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = F.size(F.filter(F.array(*map(F.lit, ("the", "und", "que"))), lambda k: F.contains(text, k)))
    return table(spark, sf, "documents").select("doc_id", F.least(F.lit(100), 15 * hits + 20 * F.contains(text, F.lit("license")).cast("int")).cast("long").alias("score"))


@query("sc_benchmark_route", "SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'sector:' || o_orderstatus END, CASE WHEN o_custkey % 5 = 0 THEN 'style:growth' END, CASE o_orderpriority WHEN '1-URGENT' THEN 'type:urgent' WHEN '5-LOW' THEN 'type:low' END, 'default') AS benchmark FROM orders")
def sc_benchmark_route(spark: SparkSession, sf: str) -> DataFrame:
    by_type = F.when(C("o_orderpriority") == "1-URGENT", "type:urgent").when(C("o_orderpriority") == "5-LOW", "type:low")
    route = F.coalesce(F.when(C("o_custkey") % 3 == 0, F.concat(F.lit("sector:"), C("o_orderstatus"))), F.when(C("o_custkey") % 5 == 0, "style:growth"), by_type, F.lit("default"))
    return table(spark, sf, "orders").select("o_orderkey", route.alias("benchmark"))
