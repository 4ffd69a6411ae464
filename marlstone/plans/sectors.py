"""Market breadth, sector features and strength, high positions, regime and strategy statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scores as S
from marlstone.functions.series import change, full, rolling_mean
from marlstone.operators.joins import in_force
from marlstone.operators.ordering import materialised
from marlstone.plans.joins import text_day
from marlstone.plans.market import FEATURES_SQL, average_percentile, feature_rows, latest, stock_features
from marlstone.plans.scores import SCORED_SQL, scored_days
from marlstone.registry import query
from marlstone.sources.tables import BARS_SQL, DECISIONS_SQL, MARKET_SQL, MEMBERSHIP_SQL, bars, decisions, market_days, membership, table

C = F.col
SNAP = 0.5003717


def snap(x: Column, places: int = 6) -> Column:
    """Rounded with the boundary off exact halves, so that sums taken in another order agree."""
    return F.floor(x * 10**places + SNAP) / 10**places


def snap_any(x: Column, places: int = 6) -> Column:
    """``snap`` of values that may be infinite, NaN or too large for a bigint: doubles from 2 ** 53 on are whole already."""
    v = x * 10**places + SNAP
    return F.when(F.abs(v) < 2.0**53, F.floor(v)).otherwise(v) / 10**places


def snap_sql(x: str, places: int = 6) -> str:
    return f"floor(({x}) * {10**places} + {SNAP}) / {10**places}"


def share(c: Column) -> Column:
    """Share of the rows where c is true among those where it is known."""
    return F.avg(c.cast("double"))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


AT = "1999-06-30"
_LAST2 = f"l2 AS (SELECT symbol, d, close, amount, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) - 1 AS r FROM bars WHERE d <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1)"


def last_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Latest bar of each symbol up to AT with its change."""
    b = bars(spark, sf).where(C("d") <= AT)
    return latest(b.select("symbol", "d", "close", "amount", change(C("close")).alias("r")))


@query("ag_breadth_hist", f"WITH {BARS_SQL}, {_LAST2} SELECT count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down, count(*) FILTER (r >= 0.098) AS limit_up, count(*) FILTER (r <= -0.098) AS limit_down, round(sum(amount), 2) AS amount, round(count(r) / count(*), 6) AS coverage FROM l2")
def ag_breadth_hist(spark: SparkSession, sf: str) -> DataFrame:
    r = C("r")
    return last_changes(spark, sf).agg(
        count_if(r > 0).alias("up"), count_if(r < 0).alias("down"), count_if(r >= 0.098).alias("limit_up"), count_if(r <= -0.098).alias("limit_down"),
        F.round(F.sum("amount"), 2).alias("amount"), F.round(F.count("r") / F.count("*"), 6).alias("coverage"),
    )


@query("ag_breadth_live", f"WITH {BARS_SQL}, {_LAST2}, t AS (SELECT sum(amount) AS top FROM (SELECT amount FROM l2 ORDER BY amount DESC, symbol LIMIT 10)) SELECT count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down, round(sum(amount), 2) AS amount, round(any_value(top) / sum(amount), 6) AS top10_share FROM l2, t")
def ag_breadth_live(spark: SparkSession, sf: str) -> DataFrame:
    q = last_changes(spark, sf)
    top = q.orderBy(F.desc("amount"), "symbol").limit(10).agg(F.sum("amount").alias("top"))
    out = q.agg(count_if(C("r") > 0).alias("up"), count_if(C("r") < 0).alias("down"), F.sum("amount").alias("amount"))
    return out.join(F.broadcast(top)).select("up", "down", F.round("amount", 2).alias("amount"), F.round(C("top") / C("amount"), 6).alias("top10_share"))


@query("ag_index_snapshot", f"WITH {FEATURES_SQL} SELECT {snap_sql('avg(r5)')} AS r5, {snap_sql('avg(r20)')} AS r20, {snap_sql('avg(volatility)')} AS volatility FROM feat WHERE symbol IN (1, 2, 3)")
def ag_index_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of three index symbols."""
    f = stock_features(bars(spark, sf).where(C("symbol").isin(1, 2, 3)))
    return f.agg(*(snap(F.avg(x)).alias(x) for x in ("r5", "r20", "volatility")))


_SCORES = ("breadth", "trend", "crowding", "rotation", "drawdown_risk", "retreat")


@query("ag_market_features", f"WITH {SCORED_SQL} SELECT strftime(d, '%Y-%m') AS month, count(*) AS days, " + ", ".join(f"{snap_sql(f'avg({x})', 4)} AS {x}" for x in _SCORES) + f", {snap_sql('stddev_samp(r1)')} AS dispersion, max(limit_up) AS most_limit_up FROM scored GROUP BY 1")
def ag_market_features(spark: SparkSession, sf: str) -> DataFrame:
    s = scored_days(spark, sf).groupBy(F.date_format("d", "yyyy-MM").alias("month"))
    return s.agg(F.count("*").alias("days"), *(snap(F.avg(x), 4).alias(x) for x in _SCORES), snap(F.stddev_samp("r1")).alias("dispersion"), F.max("limit_up").alias("most_limit_up"))


# ---- sectors

_SECTOR = f"""{FEATURES_SQL}, {MEMBERSHIP_SQL}, dd AS (
  SELECT symbol, least(min(x), 0) * 100 AS drawdown FROM (SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS x FROM (SELECT *, max(n) OVER (PARTITION BY symbol) AS nn FROM bars) WHERE n > nn - 21) GROUP BY symbol
), sm AS (SELECT m.sector, f.*, dd.drawdown FROM feat f JOIN member m ON m.symbol = f.symbol AND valid_from <= f.d AND (valid_to IS NULL OR valid_to >= f.d) JOIN dd ON dd.symbol = f.symbol),
mkt AS (SELECT avg(r5) AS m5, avg(r20) AS m20, sum(amount) AS total FROM feat),
sec AS (SELECT sector, count(*) AS universe, median(r1) AS r1, median(r5) AS r5, median(r20) AS r20, avg(CASE WHEN r1 > 0 THEN 1.0 WHEN r1 IS NOT NULL THEN 0.0 END) AS up_ratio,
  avg(above_ma20::INT) AS ma20_ratio, avg(above_ma60::INT) AS ma60_ratio, avg(new_high::INT) AS high_ratio, avg(CASE WHEN r5 > 0 THEN 1.0 WHEN r5 IS NOT NULL THEN 0.0 END) AS r5_ratio,
  sum(amount) / any_value(total) AS amount_share, median(volatility) AS volatility, median(drawdown) AS drawdown, median(r5) - any_value(m5) AS rel5, median(r20) - any_value(m20) AS rel20, median(n) AS records
  FROM sm, mkt GROUP BY sector)"""


def sector_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sector over all its members at their latest bar: medians, ratios of the known, share of turnover.

    Bars are read and folded once: of each symbol the last 21 rows are stored, from which everything else comes.
    """
    rows = feature_rows(bars(spark, sf)).withColumn("last", F.count("*").over(Window.partitionBy("symbol")))
    recent = materialised(rows.where("n > last - 21"))
    f = recent.where("n = last").drop("last")
    peak = F.max("close").over(Window.partitionBy("symbol").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    worst = recent.withColumn("x", C("close") / peak - 1).groupBy("symbol").agg((F.least(F.min("x"), F.lit(0.0)) * 100).alias("drawdown"))
    m = in_force(f, F.broadcast(membership(spark, sf)), "symbol", "d").join(worst, "symbol")
    market = f.agg(F.avg("r5").alias("m5"), F.avg("r20").alias("m20"), F.sum("amount").alias("total"))  # one row
    med = lambda x: F.median(x)
    return (
        m.join(F.broadcast(market))
        .groupBy("sector")
        .agg(
            F.count("*").alias("universe"), med("r1").alias("r1"), med("r5").alias("r5"), med("r20").alias("r20"),
            share(C("r1") > 0).alias("up_ratio"), share(C("above_ma20")).alias("ma20_ratio"), share(C("above_ma60")).alias("ma60_ratio"),
            share(C("new_high")).alias("high_ratio"), share(C("r5") > 0).alias("r5_ratio"), (F.sum("amount") / F.max("total")).alias("amount_share"),
            med("volatility").alias("volatility"), med("drawdown").alias("drawdown"), (med("r5") - F.max("m5")).alias("rel5"),
            (med("r20") - F.max("m20")).alias("rel20"), med("n").cast("double").alias("records"),
        )
    )


_SEC_COLS = ("r1", "r5", "r20", "up_ratio", "ma20_ratio", "ma60_ratio", "high_ratio", "r5_ratio", "amount_share", "volatility", "drawdown", "rel5", "rel20")


@query("ag_sector", f"WITH {_SECTOR} SELECT sector, universe, " + ", ".join(f"{snap_sql(x)} AS {x}" for x in _SEC_COLS) + " FROM sec")
def ag_sector(spark: SparkSession, sf: str) -> DataFrame:
    return sector_features(spark, sf).select("sector", "universe", *(snap(C(x)).alias(x) for x in _SEC_COLS))


@query("ag_sector_sampled", f"WITH {FEATURES_SQL}, {MEMBERSHIP_SQL}, s AS (SELECT m.sector, f.symbol, f.r5, row_number() OVER (PARTITION BY m.sector ORDER BY f.symbol) AS k FROM feat f JOIN member m ON m.symbol = f.symbol AND valid_to IS NULL) SELECT sector, {snap_sql('avg(r5)')} AS r5, count(*) AS n FROM s WHERE k <= 3 GROUP BY 1")
def ag_sector_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """The degraded form: the first three members of each sector (the limit is the feature)."""
    f = stock_features(bars(spark, sf)).select("symbol", "r5")
    m = f.join(F.broadcast(membership(spark, sf).where("valid_to is null").select("symbol", "sector")), "symbol")
    k = F.row_number().over(Window.partitionBy("sector").orderBy("symbol"))
    return m.withColumn("k", k).where("k <= 3").groupBy("sector").agg(snap(F.avg("r5")).alias("r5"), F.count("*").alias("n"))


def mean_present(*xs: Column) -> Column:
    """Mean of those that are not null."""
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / n)


#: Components of the strength of a sector with their weights; risk is taken off.
WEIGHTS = {"trend": 0.25, "breadth": 0.25, "relative": 0.20, "liquidity": 0.15, "momentum": 0.10, "risk": -0.05}


def strength(features: DataFrame) -> DataFrame:
    """(sector, score, rank, flags): components clipped to their 1st and 99th percentile, ranked as percentiles over all
    sectors and weighted; a missing one counts as 50. Sectors are few: one window holds them."""
    parts = {
        "trend": mean_present(C("r5"), C("r20")),
        "breadth": mean_present(*(C(x) for x in ("up_ratio", "ma20_ratio", "ma60_ratio", "high_ratio", "r5_ratio"))),
        "relative": mean_present(C("rel5"), C("rel20")),
        "liquidity": C("amount_share"),
        "momentum": C("r1"),
        "risk": mean_present(C("volatility"), F.abs("drawdown")),
    }
    raw = features.select("sector", "records", F.lit(0).alias("day"), *(snap(c, 9).alias(k) for k, c in parts.items()))
    cuts = raw.groupBy("day").agg(*(F.percentile(k, q).alias(f"{k}_{n}") for k in parts for q, n in ((0.01, "lo"), (0.99, "hi"))))
    x = raw.join(F.broadcast(cuts), "day")
    x = x.withColumns({k: F.when(C(k).isNotNull(), F.least(F.greatest(k, f"{k}_lo"), f"{k}_hi")) for k in parts})
    x = x.withColumns({f"{k}_p": average_percentile(C(k), ["day"]) for k in parts})
    score = sum((w * F.coalesce(C(f"{k}_p"), F.lit(50.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    flags = S.codes({"INSUFFICIENT_HISTORY": C("records") < 60, "COMPONENT_DATA_MISSING": F.greatest(*(C(f"{k}_p").isNull() for k in parts))})
    x = x.select("sector", "day", snap(S.clip(score, 0, 100), 2).alias("score"), F.array_join(flags, ",").alias("flags"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "sector")).cast("long")).drop("day")


_PARTS = {"trend": "(r5 + r20) / 2", "breadth": "(up_ratio + ma20_ratio + ma60_ratio + high_ratio + r5_ratio) / 5", "relative": "(rel5 + rel20) / 2", "liquidity": "amount_share", "momentum": "r1", "risk": "(volatility + abs(drawdown)) / 2"}
_RAW = ", ".join(f"{snap_sql(v, 9)} AS {k}" for k, v in _PARTS.items())
_CLIP = ", ".join(f"least(greatest({k}, (SELECT quantile_cont({k}, 0.01) FROM sraw)), (SELECT quantile_cont({k}, 0.99) FROM sraw)) AS {k}" for k in _PARTS)
_PCT = ", ".join(f"CASE WHEN count(*) OVER () = 1 THEN 100.0 ELSE (rank() OVER (ORDER BY {k}) - 1 + (count(*) OVER (PARTITION BY {k}) - 1) / 2.0) / (count(*) OVER () - 1) * 100 END AS {k}_p" for k in _PARTS)
_SUM = " + ".join(f"({w}) * {k}_p" for k, w in WEIGHTS.items())
STRENGTH_SQL = f"""{_SECTOR}, sraw AS (SELECT sector, records, {_RAW} FROM sec), sclip AS (SELECT sector, records, {_CLIP} FROM sraw), spct AS (SELECT sector, records, {_PCT} FROM sclip),
sscore AS (SELECT sector, {snap_sql(f'greatest(0.0, least(100.0, {_SUM}))', 2)} AS score, CASE WHEN records < 60 THEN 'INSUFFICIENT_HISTORY' ELSE '' END AS flags FROM spct)"""


@query("wf_strength", f"WITH {STRENGTH_SQL} SELECT sector, score, flags, row_number() OVER (ORDER BY score DESC, sector) AS rank FROM sscore")
def wf_strength(spark: SparkSession, sf: str) -> DataFrame:
    return strength(sector_features(spark, sf))


@query("pl_sector_strength", f"WITH {STRENGTH_SQL} SELECT sector, score, row_number() OVER (ORDER BY score DESC, sector) AS rank FROM sscore QUALIFY rank <= 3")
def pl_sector_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Membership, bars, features, normalisation and ranking in one plan; the best three."""
    return strength(sector_features(spark, sf)).where("rank <= 3").select("sector", "score", "rank")



# ---- high positions


def pool_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol at the day before the outcome day: returns, nearness to the 60-day high, turnover and recent limit-ups;
    with the outcome of the following bar."""
    w = Window.partitionBy("symbol").orderBy("d")
    b = bars(spark, sf).withColumn("r1", change(C("close")))
    b = b.select(
        "symbol", "d", "close", "open", F.row_number().over(w).alias("n"), change(C("close"), 20).alias("ret20"), F.coalesce(change(C("close"), 60), change(C("close"), 20)).alias("ret60"),
        (C("close") >= 0.95 * F.max("high").over(w.rowsBetween(-59, 0))).alias("near"), (C("amount") / F.avg("amount").over(w.rowsBetween(-19, 0))).alias("amount_ratio"),
        (F.max("r1").over(w.rowsBetween(-9, 0)) >= 0.098).alias("limited"), F.lead("r1").over(w).alias("next_r"), F.lead("close").over(w).alias("next_close"),
        F.lead(rolling_mean(C("close"), 20)).over(w).alias("next_ma20"), F.lead("open").over(w).alias("next_open"), F.lead("d").over(w).alias("next_d"),
    )
    known = b.where((C("n") >= 25) & (C("next_d") <= AT))
    return latest(known)


_POOL = f"""hp0 AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS r1, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)),
hp1 AS (SELECT symbol, d, n, close / lag(close, 20) OVER s - 1 AS ret20, coalesce(close / lag(close, 60) OVER s - 1, close / lag(close, 20) OVER s - 1) AS ret60,
  close >= 0.95 * max(high) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS near, amount / avg(amount) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS amount_ratio,
  max(r1) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 0.098 AS limited, lead(r1) OVER s AS next_r, lead(close) OVER s AS next_close, lead(ma20) OVER s AS next_ma20, lead(open) OVER s AS next_open, lead(d) OVER s AS next_d
  FROM hp0 WINDOW s AS (PARTITION BY symbol ORDER BY d)),
hp AS (SELECT * FROM hp1 WHERE n >= 25 AND next_d <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1),
hq AS (SELECT quantile_cont(ret20, 0.9) AS q20, quantile_cont(ret60, 0.9) AS q60, quantile_cont(amount_ratio, 0.8) AS qa FROM hp),
hpool AS (SELECT hp.*, ret20 >= q20 OR ret60 >= q60 AS leader FROM hp, hq WHERE ((ret20 >= q20 OR ret60 >= q60) OR near OR limited) AND (amount_ratio >= qa OR limited OR (ret20 >= q20 OR ret60 >= q60)))"""


@query("ag_high_position", f"WITH {BARS_SQL}, {_POOL} SELECT count(*) AS pool, count(*) FILTER (leader) AS leaders, {snap_sql('avg((next_r < 0)::INT)')} AS loss_rate, {snap_sql('avg((next_r <= -0.098)::INT)')} AS limit_down_rate, {snap_sql('avg((next_close < next_ma20)::INT)')} AS breakdown_rate, count(*) FILTER (next_r <= -0.07 OR next_close / next_open - 1 <= -0.05) AS big_negative, count(*) >= 10 AS usable FROM hpool")
def ag_high_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = pool_rows(spark, sf)
    cuts = rows.agg(F.percentile("ret20", 0.9).alias("q20"), F.percentile("ret60", 0.9).alias("q60"), F.percentile("amount_ratio", 0.8).alias("qa"))
    x = rows.join(F.broadcast(cuts)).withColumn("leader", (C("ret20") >= C("q20")) | (C("ret60") >= C("q60")))
    pool = x.where((C("leader") | C("near") | C("limited")) & ((C("amount_ratio") >= C("qa")) | C("limited") | C("leader")))
    negative = (C("next_r") <= -0.07) | (C("next_close") / C("next_open") - 1 <= -0.05)
    return pool.agg(
        F.count("*").alias("pool"), F.coalesce(count_if(C("leader")), F.lit(0)).alias("leaders"), snap(share(C("next_r") < 0)).alias("loss_rate"), snap(share(C("next_r") <= -0.098)).alias("limit_down_rate"),
        snap(share(C("next_close") < C("next_ma20"))).alias("breakdown_rate"), F.coalesce(count_if(negative), F.lit(0)).alias("big_negative"), (F.count("*") >= 10).alias("usable"),
    )


# ---- regimes and strategies


@query("ag_regime_strategy", f"WITH {DECISIONS_SQL} SELECT regime, strategy, horizon, count(*) AS n, {snap_sql('avg(excess)')} AS mean, {snap_sql('median(excess)')} AS median, {snap_sql('avg((excess > 0)::INT)')} AS hit_rate FROM decision WHERE excess IS NOT NULL GROUP BY ALL")
def ag_regime_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return regime_strategy(decisions(spark, sf))


def regime_strategy(d: DataFrame) -> DataFrame:
    g = d.where("excess is not null").groupBy("regime", "strategy", "horizon")
    return g.agg(F.count("*").alias("n"), snap(F.avg("excess")).alias("mean"), snap(F.median("excess")).alias("median"), snap(share(C("excess") > 0)).alias("hit_rate"))


@query("ag_route_summary", f"WITH {DECISIONS_SQL}, s AS (SELECT regime, strategy, horizon, count(*) AS n, round(avg(excess), 4) AS mean FROM decision WHERE excess IS NOT NULL GROUP BY ALL) SELECT regime, strategy, {snap_sql('sum(mean * n) / sum(n)')} AS weighted_mean, max(n) AS most, string_agg(horizon::VARCHAR || '=' || n::VARCHAR, ',' ORDER BY horizon) AS by_horizon FROM s GROUP BY 1, 2 HAVING max(n) >= 5")
def ag_route_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = decisions(spark, sf).where("excess is not null").groupBy("regime", "strategy", "horizon").agg(F.count("*").alias("n"), F.round(F.avg("excess"), 4).alias("mean"))
    pair = F.struct("horizon", F.concat_ws("=", C("horizon").cast("string"), C("n").cast("string")).alias("t"))
    out = s.groupBy("regime", "strategy").agg(snap(F.sum(C("mean") * C("n")) / F.sum("n")).alias("weighted_mean"), F.max("n").alias("most"), F.array_sort(F.collect_list(pair)).alias("p"))  # three horizons
    return out.where("most >= 5").select("regime", "strategy", "weighted_mean", "most", F.array_join(F.transform("p", lambda x: x["t"]), ",").alias("by_horizon"))


@query("ag_strategy_perf", f"WITH {DECISIONS_SQL} SELECT strategy, {snap_sql('avg(excess)')} AS mean, {snap_sql('avg((excess > 0)::INT)')} AS success FROM decision WHERE excess IS NOT NULL GROUP BY 1")
def ag_strategy_perf(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).where("excess is not null").groupBy("strategy").agg(snap(F.avg("excess")).alias("mean"), snap(share(C("excess") > 0)).alias("success"))


EVIDENCE_SQL = """ev AS (SELECT event_id, user_id AS memory_id, ts, (event_id % 201 - 100) / 2000::DOUBLE AS excess, CASE WHEN event_id % 7 <> 0 THEN (event_id % 11) / 10::DOUBLE END AS quality, CASE WHEN event_id % 5 <> 0 THEN (event_id % 13) / 12::DOUBLE END AS fit FROM events),
ew AS (SELECT *, CASE WHEN abs(excess) < 0.01 THEN 0 WHEN excess > 0 THEN 1 WHEN excess < 0 THEN -1 ELSE 0 END AS dir,
  least(1.0, greatest(0.0, coalesce(quality, 0.5))) * least(1.0, greatest(0.0, coalesce(fit, 1.0))) * least(1.0, abs(excess) / 0.01) * pow(0.5, greatest(0, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ts)) / 86400.0 / 180.0) AS w FROM ev)"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence events of memories with their direction and weight at 2024-02-01."""
    k = C("event_id")
    e = table(spark, sf, "events").select(
        k, C("user_id").alias("memory_id"), "ts", ((k % 201 - 100) / 2000.0).alias("excess"), F.when(k % 7 != 0, (k % 11) / 10.0).alias("quality"), F.when(k % 5 != 0, (k % 13) / 12.0).alias("fit")
    )
    return e.withColumn("dir", direction(C("excess"))).withColumn("w", evidence_weight(C("excess"), C("quality"), C("fit"), C("ts"), F.lit("2024-02-01").cast("timestamp")))


def direction(excess: Column, threshold: float = 0.01) -> Column:
    return F.when(excess.isNull() | (F.abs(excess) < threshold), 0).otherwise(F.signum(excess).cast("int"))


def evidence_weight(excess: Column, quality: Column, fit: Column, at: Column, now: Column, threshold: float = 0.01, half_life: float = 180.0) -> Column:
    """Quality, applicability, size of the effect and age of one piece of evidence, in 0 to 1."""
    age = F.greatest(F.lit(0.0), (now.cast("double") - at.cast("timestamp").cast("double")) / 86400.0)
    size = F.coalesce(F.least(F.lit(1.0), F.abs(excess) / threshold), F.lit(1.0))
    return S.clip(F.coalesce(quality, F.lit(0.5)), 0, 1) * S.clip(F.coalesce(fit, F.lit(1.0)), 0, 1) * size * F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(1.0))


@query("sc_evidence_weight", f"WITH {EVIDENCE_SQL} SELECT event_id, dir, {snap_sql('w', 8)} AS weight FROM ew")
def sc_evidence_weight(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).select("event_id", "dir", snap(C("w"), 8).alias("weight"))


@query("ag_confidence", f"WITH {EVIDENCE_SQL} SELECT memory_id, {snap_sql('greatest(0.0, least(1.0, (1 + sum(dir * w)) / (2 + sum(w))))')} AS confidence FROM ew GROUP BY 1")
def ag_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).groupBy("memory_id").agg(snap(confidence()).alias("confidence"))


def confidence() -> Column:
    return S.clip((1 + F.sum(C("dir") * C("w"))) / (2 + F.sum("w")), 0, 1)


@query("ag_evidence_summary", f"WITH {EVIDENCE_SQL} SELECT memory_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS last_day, {snap_sql('avg(excess)')} AS mean_excess, {snap_sql('avg(quality)')} AS mean_quality FROM ew GROUP BY 1")
def ag_evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).groupBy("memory_id").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), snap(F.avg("excess")).alias("mean_excess"), snap(F.avg("quality")).alias("mean_quality"))


@query("fd_memory_evidence", f"WITH {EVIDENCE_SQL}, c AS (SELECT memory_id, count(*) AS n, greatest(0.0, least(1.0, (1 + sum(dir * w)) / (2 + sum(w)))) AS c FROM ew GROUP BY 1) SELECT memory_id, n, CASE WHEN n >= 3 AND c >= 0.7 THEN 'CONFIRMED' WHEN n >= 3 AND c <= 0.3 THEN 'DEPRECATED' ELSE 'ACTIVE' END AS status FROM c")
def fd_memory_evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = evidence(spark, sf).groupBy("memory_id").agg(F.count("*").alias("n"), confidence().alias("c"))
    status = F.when((C("n") >= 3) & (C("c") >= 0.7), "CONFIRMED").when((C("n") >= 3) & (C("c") <= 0.3), "DEPRECATED").otherwise("ACTIVE")
    return c.select("memory_id", "n", status.alias("status"))


@query("wf_streak", f"WITH {EVIDENCE_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY memory_id, dir ORDER BY ts, event_id) AS island FROM ew WHERE dir <> 0) SELECT event_id, memory_id, dir, row_number() OVER (PARTITION BY memory_id, dir, island ORDER BY ts, event_id) AS streak FROM g")
def wf_streak(spark: SparkSession, sf: str) -> DataFrame:
    """How many pieces of evidence in a row had this direction."""
    order = ("ts", "event_id")
    own = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    g = evidence(spark, sf).where("dir <> 0").withColumn("island", own("memory_id") - own("memory_id", "dir"))
    return g.select("event_id", "memory_id", "dir", own("memory_id", "dir", "island").cast("long").alias("streak"))


# ---- portfolios, flows, coverage


@query("ag_portfolio_risk", "WITH p AS (SELECT c_custkey AS symbol, c_mktsegment AS theme, c_acctbal AS v FROM customer WHERE c_acctbal > 0), t AS (SELECT theme, round(sum(v) / (SELECT sum(v) FROM p), 6) AS weight, count(*) AS n, max(v) / (SELECT sum(v) FROM p) AS top FROM p GROUP BY 1) SELECT theme, weight, n, round(top, 6) AS largest, CASE WHEN weight > 0.2 THEN 'THEME_OVER_LIMIT' ELSE '' END AS warning FROM t")
def ag_portfolio_risk(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").where("c_acctbal > 0").select(C("c_mktsegment").alias("theme"), C("c_acctbal").alias("v"))
    g = p.groupBy("theme").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.max("v").alias("m"))
    total = g.agg(F.sum("s").alias("total"))
    out = g.join(F.broadcast(total)).select("theme", F.round(C("s") / C("total"), 6).alias("weight"), "n", F.round(C("m") / C("total"), 6).alias("largest"))
    return out.withColumn("warning", F.when(C("weight") > 0.2, "THEME_OVER_LIMIT").otherwise(""))


@query("ag_fund_flow", "SELECT l_suppkey AS symbol, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net, CAST(sign(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END)) AS INT) AS side FROM lineitem GROUP BY 1")
def ag_fund_flow(spark: SparkSession, sf: str) -> DataFrame:
    flow = F.sum(F.when(C("l_returnflag") == "R", -C("l_extendedprice")).otherwise(C("l_extendedprice")))
    return table(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("symbol")).agg(F.round(flow, 2).alias("net"), F.signum(flow).cast("int").alias("side"))


@query("ag_flag_counts", "SELECT flag, count(*) AS n, flag LIKE '%URGENT%' OR flag LIKE '%HIGH%' AS critical FROM (SELECT unnest([o_orderpriority, 'STATUS_' || o_orderstatus]) AS flag FROM orders) GROUP BY 1")
def ag_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").select(F.explode(F.array("o_orderpriority", F.concat(F.lit("STATUS_"), "o_orderstatus"))).alias("flag"))
    return f.groupBy("flag").agg(F.count("*").alias("n")).withColumn("critical", C("flag").contains("URGENT") | C("flag").contains("HIGH"))


@query("ag_hist_coverage", f"WITH {MARKET_SQL}, days AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY))::DATE AS d) SELECT strftime(days.d, '%Y-%m-%d') AS d, round(coalesce(n, 0) / 100.0, 6) AS coverage, coalesce(n, 0) / 100.0 < 0.2 AS failed FROM days LEFT JOIN market USING (d)")
def ag_hist_coverage(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(date'1996-01-01', date'1996-12-31')")).alias("d"))
    cover = F.coalesce("n", F.lit(0)) / 100.0
    return days.join(market_days(spark, sf), "d", "left").select(text_day("d"), F.round(cover, 6).alias("coverage"), (cover < 0.2).alias("failed"))


@query("ag_paper_evidence", "SELECT event_type AS strategy, count(DISTINCT CAST(ts AS DATE)) AS days, round(avg((value < 0)::INT), 6) AS error_rate, count(DISTINCT CAST(ts AS DATE)) >= 20 AND avg((value < 0)::INT) <= 0.05 AS passes FROM events GROUP BY 1")
def ag_paper_evidence(spark: SparkSession, sf: str) -> DataFrame:
    days, errors = F.count_distinct(F.to_date("ts")), share(C("value") < 0)
    return table(spark, sf, "events").groupBy(C("event_type").alias("strategy")).agg(days.alias("days"), F.round(errors, 6).alias("error_rate"), ((days >= 20) & (errors <= 0.05)).alias("passes"))


@query("ag_skill_evidence", "SELECT user_id AS skill, round(avg((event_type = 'error')::INT), 6) AS tool_errors, round(avg((CAST(json_extract(props, '$.k') AS INT) > 50)::INT), 6) AS contract_failures FROM events GROUP BY 1")
def ag_skill_evidence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").groupBy(C("user_id").alias("skill")).agg(F.round(share(C("event_type") == "error"), 6).alias("tool_errors"), F.round(share(k > 50), 6).alias("contract_failures"))


@query("ag_distinct_count", "SELECT count(DISTINCT l_suppkey) AS symbols, count(DISTINCT l_partkey) AS parts FROM lineitem")
def ag_distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_suppkey").alias("symbols"), F.count_distinct("l_partkey").alias("parts"))


@query("ag_next_version", "SELECT o_custkey AS memory_id, max(o_orderkey % 50) + 1 AS by_max, count(*) + 1 AS by_count FROM orders GROUP BY 1")
def ag_next_version(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(C("o_custkey").alias("memory_id")).agg((F.max(C("o_orderkey") % 50) + 1).alias("by_max"), (F.count("*") + 1).alias("by_count"))


# ---- price patterns that need a sector's or a theme's strength


@query("sig_b1", f"""WITH {BARS_SQL}, q0 AS (SELECT *, ({' + '.join(f'CASE WHEN n >= {k} THEN avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END' for k in (14, 28, 57, 114))}) / 4 AS ltl,
 volume / nullif(CASE WHEN n >= 20 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 0) AS vr FROM bars),
 q1 AS (SELECT *, sum((close < ltl)::INT) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS below FROM q0), z AS (SELECT symbol, d, CASE WHEN close >= 0.975 * ltl THEN 24 ELSE 0 END + CASE WHEN low >= 0.94 * ltl THEN 12 ELSE 0 END + CASE WHEN coalesce(below, 0) <= 4 THEN 12 ELSE 0 END + CASE WHEN vr <= 1.1 THEN 18 ELSE 0 END + CASE WHEN symbol % 3 = 0 THEN 10 ELSE 0 END AS score FROM q1 WHERE n >= 114)
 SELECT symbol, strftime(d, '%Y-%m-%d') AS d, score::BIGINT AS score, score >= 70 AS fires FROM z WHERE score >= 60""")
def sig_b1(spark: SparkSession, sf: str) -> DataFrame:
    """A pullback to the long line; every third symbol's sector is strong here, and the oscillator's part is left out."""
    w = Window.partitionBy("symbol").orderBy("d")
    ltl = sum((rolling_mean(C("close"), k) for k in (14, 28, 57, 114)), F.lit(0.0)) / 4
    b = bars(spark, sf).select("symbol", "d", "close", "low", F.row_number().over(w).alias("n"), ltl.alias("ltl"), (C("volume") / full(C("volume"), 20, F.avg)).alias("vr"))
    b = b.withColumn("below", F.sum((C("close") < C("ltl")).cast("int")).over(w.rowsBetween(-9, 0))).where("n >= 114")
    parts = [(C("close") >= 0.975 * C("ltl"), 24), (C("low") >= 0.94 * C("ltl"), 12), (F.coalesce("below", F.lit(0)) <= 4, 12), (C("vr") <= 1.1, 18), (C("symbol") % 3 == 0, 10)]
    score = sum((F.when(p, k).otherwise(0) for p, k in parts), F.lit(0)).cast("long")
    return b.withColumn("score", score).where("score >= 60").select("symbol", text_day("d"), "score", (C("score") >= 70).alias("fires"))


@query("sig_b3", f"""WITH {BARS_SQL}, q AS (SELECT *, lag(close, 39) OVER s AS c40, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma10, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20,
 volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS vr, max(high) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS top FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY d)),
 z AS (SELECT symbol, d, greatest(0, CASE WHEN close / c40 > 1.15 THEN 20 ELSE 0 END + CASE WHEN close >= ma10 * 0.98 THEN 20 ELSE 0 END + CASE WHEN close >= ma20 THEN 20 ELSE 0 END + CASE WHEN vr <= 1.5 THEN 15 ELSE 0 END + CASE WHEN symbol % 4 = 0 THEN 15 ELSE 0 END - CASE WHEN close / top > 0.98 AND vr > 1.8 THEN 15 ELSE 0 END) AS score FROM q WHERE n >= 40)
 SELECT symbol, strftime(d, '%Y-%m-%d') AS d, score::BIGINT AS score, score >= 70 AS fires FROM z WHERE score >= 60""")
def sig_b3(spark: SparkSession, sf: str) -> DataFrame:
    """A pause within a rise; every fourth symbol's theme is strong here."""
    w = Window.partitionBy("symbol").orderBy("d")
    b = bars(spark, sf).select(
        "symbol", "d", "close", F.row_number().over(w).alias("n"), F.lag("close", 39).over(w).alias("c40"), rolling_mean(C("close"), 10).alias("ma10"), rolling_mean(C("close"), 20).alias("ma20"),
        (C("volume") / full(C("volume"), 20, F.avg)).alias("vr"), F.max("high").over(w.rowsBetween(-19, 0)).alias("top"),
    ).where("n >= 40")
    parts = [(C("close") / C("c40") > 1.15, 20), (C("close") >= C("ma10") * 0.98, 20), (C("close") >= C("ma20"), 20), (C("vr") <= 1.5, 15), (C("symbol") % 4 == 0, 15), ((C("close") / C("top") > 0.98) & (C("vr") > 1.8), -15)]
    score = F.greatest(F.lit(0), sum((F.when(p, k).otherwise(0) for p, k in parts), F.lit(0))).cast("long")
    return b.withColumn("score", score).where("score >= 60").select("symbol", text_day("d"), "score", (C("score") >= 70).alias("fires"))
