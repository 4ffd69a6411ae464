"""Tick streams, sources and sinks, and pipelines over whole days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.series import change, rolling_mean
from marlstone.operators.regimes import confirm
from marlstone.plans.backtests import MACHINE_SQL, regime_days
from marlstone.plans.joins import CALENDAR_SQL, calendar, text_day
from marlstone.plans.market import RULES_SQL, rule_scan
from marlstone.plans.sectors import STRENGTH_SQL, mean_present, sector_features, snap, snap_any, snap_sql, strength
from marlstone.registry import query
from marlstone.sources import stores
from marlstone.sources.tables import BARS_SQL, MARKET_SQL, TICKS_SQL, bars, market_days, table, ticks
from marlstone.streaming import ticks as T
from marlstone.streaming.live import FIELDS, RETENTION, Live

C = F.col

#: The log: every event in the order of its id, and each fiftieth once more 700 events later.
LOG_SQL = f"""{TICKS_SQL}, log AS (SELECT *, event_id * 2 AS arrival FROM ticks UNION ALL SELECT *, (event_id + 700) * 2 + 1 FROM ticks WHERE event_id % 50 = 0),
jd AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1 AS first FROM log), jm AS (SELECT *, max(CASE WHEN first THEN event_time END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM jd),
judged AS (SELECT *, CASE WHEN NOT first THEN 'DUPLICATE_EVENT' WHEN event_time < latest - INTERVAL 5 SECOND THEN 'LATE_EVENT' ELSE 'ACCEPTED' END AS verdict FROM jm)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    again = t.where("event_id % 50 = 0").withColumn("arrival", (C("event_id") + 700) * 2 + 1)
    return t.withColumn("arrival", C("event_id") * 2).unionByName(again)


@query("st_process", f"WITH {LOG_SQL} SELECT arrival, event_id, verdict FROM judged")
def st_process(spark: SparkSession, sf: str) -> DataFrame:
    return T.judged(log(spark, sf)).select("arrival", "event_id", "verdict")


@query("st_watermark", f"WITH {LOG_SQL} SELECT arrival, strftime(latest - INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') AS watermark FROM judged")
def st_watermark(spark: SparkSession, sf: str) -> DataFrame:
    j = T.judged(log(spark, sf))
    return j.select("arrival", F.date_format(C("latest") - F.expr("interval 5 seconds"), "yyyy-MM-dd HH:mm:ss").alias("watermark"))


@query("st_dedup", f"WITH {LOG_SQL} SELECT event_id, min(arrival) AS arrival, count(*) AS seen FROM log GROUP BY 1")
def st_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).groupBy("event_id").agg(F.min("arrival").alias("arrival"), F.count("*").alias("seen"))


_OLD = "arrival <= CASE WHEN n // 2 > 0 THEN mid END"
FEATURES_SQL = f"""{LOG_SQL}, ac AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n, max(arrival) OVER (PARTITION BY symbol) AS top FROM judged WHERE verdict = 'ACCEPTED'),
an AS (SELECT *, max(CASE WHEN back = 1 THEN event_time END) OVER (PARTITION BY symbol) AS now, max(CASE WHEN back = 1 THEN last END) OVER (PARTITION BY symbol) AS px FROM ac),
fe AS (SELECT symbol, any_value(now) AS now, any_value(px) AS px, max(CASE WHEN back = 1 THEN sector END) AS sector, max(CASE WHEN back = 1 THEN at_limit_up::INT END) AS limited, max(CASE WHEN back = 1 THEN volume END) AS v,
 arg_max(last, arrival) FILTER (event_time <= now - INTERVAL 60 SECOND) AS p1, arg_max(last, arrival) FILTER (event_time <= now - INTERVAL 300 SECOND) AS p5, arg_max(last, arrival) FILTER (event_time <= now - INTERVAL 900 SECOND) AS p15,
 sum(amount) / sum(volume) AS vwap, avg(volume) AS mv, max(last) AS hi, min(last) AS lo, any_value(n) AS n, sum(amount) FILTER (n - back < n // 2) AS old, sum(amount) FILTER (n - back >= n // 2) AS recent FROM an GROUP BY symbol)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return T.symbol_features(T.judged(log(spark, sf)).where("verdict = 'ACCEPTED'"), kept=None)


_OUT = {"return_1m": "px / p1 - 1", "return_5m": "px / p5 - 1", "return_15m": "px / p15 - 1", "vwap": "vwap", "vwap_distance": "px / vwap - 1", "volume_ratio": "v / mv", "amount_acceleration": "CASE WHEN n >= 4 AND old <> 0 THEN recent / old - 1 END", "position": "CASE WHEN hi > lo THEN (px - lo) / (hi - lo) ELSE 0.5 END"}


@query("st_symbol_features", f"WITH {FEATURES_SQL} SELECT symbol, " + ", ".join(f"{snap_sql(v)} AS {k}" for k, v in _OUT.items()) + " FROM fe")
def st_symbol_features(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("symbol", *(snap_any(C(k)).alias(k) for k in _OUT))


_AGG = "ag AS (SELECT sector, avg(px / p1 - 1) AS own, avg(limited) AS limit_share, count(*) AS symbols FROM fe GROUP BY 1), mk AS (SELECT avg(px / p1 - 1) AS market, avg((px / p1 - 1 > 0)::INT) AS breadth FROM fe)"


@query("st_aggregate", f"WITH {FEATURES_SQL}, {_AGG} SELECT sector, {snap_sql('own - market')} AS relative, {snap_sql('limit_share')} AS limit_share, {snap_sql('breadth')} AS breadth, symbols FROM ag, mk")
def st_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    a = T.sector_aggregate(features(spark, sf))
    return a.select("sector", *(snap_any(C(x)).alias(x) for x in ("relative", "limit_share", "breadth")), "symbols")


@query("st_overlay", f"WITH {FEATURES_SQL} SELECT c_custkey AS symbol, round(c_acctbal, 2) AS base, {snap_sql('px / p1 - 1')} AS return_1m FROM customer LEFT JOIN fe ON symbol = c_custkey")
def st_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """The daily snapshot of every symbol with what is live of it."""
    base = table(spark, sf, "customer").select(C("c_custkey").alias("symbol"), F.round("c_acctbal", 2).alias("base"))
    return base.join(features(spark, sf).select("symbol", snap_any(C("return_1m")).alias("return_1m")), "symbol", "left")


@query("st_replay", f"WITH {LOG_SQL} SELECT symbol, count(*) FILTER (verdict = 'ACCEPTED') AS accepted, count(*) FILTER (verdict = 'LATE_EVENT') AS late, count(*) FILTER (verdict = 'DUPLICATE_EVENT') AS duplicates FROM judged GROUP BY 1")
def st_replay(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda v: F.sum(F.when(C("verdict") == v, 1).otherwise(0))
    return T.judged(log(spark, sf)).groupBy("symbol").agg(n("ACCEPTED").alias("accepted"), n("LATE_EVENT").alias("late"), n("DUPLICATE_EVENT").alias("duplicates"))


#: Micro-batches into which the log is cut, and after how many of them the run is stopped and started again.
BATCHES, STOPPED_AFTER = 4, 2


def live_run(spark: SparkSession, sf: str, kept: int | None = T.KEPT) -> Live:
    """The log as a live stream: files in order of arrival, one a micro-batch. The run ends after some of them and is taken up
    again from its checkpoint when the others have come."""
    live, source = Live(stores.shared_path(spark, "live"), kept=kept), stores.shared_path(spark, "ticks")
    given = log(spark, sf).withColumn("event_time", C("event_time").cast("timestamp")).select(*FIELDS)
    size = (given.agg(F.max("arrival")).first()[0] or 0) // BATCHES + 1
    for k in range(BATCHES):
        # A part by arrival; files are taken in the order in which they were written.
        part = given.where(F.floor(C("arrival") / size) == k)
        part.coalesce(1).write.mode("append").parquet(source)
        if k + 1 in (STOPPED_AFTER, BATCHES):
            stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(source)
            live.start(stream).awaitTermination()
    return live


@query("st_batch_loop", f"WITH {FEATURES_SQL} SELECT symbol, n, " + ", ".join(f"{snap_sql(v)} AS {k}" for k, v in _OUT.items()) + " FROM fe")
def st_batch_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all symbols after a live run of several micro-batches with a restart: those of the replay."""
    live = live_run(spark, sf, kept=None)
    n = live.state(spark).groupBy("symbol").agg(F.count("*").alias("n"))
    return live.features(spark).join(n, "symbol").select("symbol", "n", *(snap_any(C(k)).alias(k) for k in _OUT))


@query("sink_redis_stream", f"WITH {LOG_SQL} SELECT arrival, event_id, verdict FROM judged WHERE event_time >= (SELECT max(event_time) FROM ticks) - INTERVAL {RETENTION} SECOND")
def sink_redis_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What a live run keeps of its log."""
    return live_run(spark, sf).log(spark).select("arrival", "event_id", "verdict")


@query("sink_state_kv", f"WITH {FEATURES_SQL} SELECT symbol, count(*) AS kept, min(arrival) AS oldest, max(arrival) AS newest, round(sum(amount), 4) AS amount FROM an WHERE back <= {T.KEPT} GROUP BY symbol")
def sink_state_kv(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each symbol that a live run leaves, read back by a batch query."""
    s = live_run(spark, sf).state(spark).groupBy("symbol")
    return s.agg(F.count("*").alias("kept"), F.min("arrival").alias("oldest"), F.max("arrival").alias("newest"), F.round(F.sum("amount"), 4).alias("amount"))


# ---- sources and sinks


@query("src_csv_cache", "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') AS code, s_name, s_acctbal FROM supplier")
def src_csv_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = stores.shared_path(spark, "csv")
    s = table(spark, sf, "supplier").select("s_suppkey", F.lpad(C("s_suppkey").cast("string"), 6, "0").alias("code"), "s_name", "s_acctbal")
    stores.write_csv(s, path)
    return stores.read_csv(spark, path, "s_suppkey bigint, code string, s_name string, s_acctbal double")


@query("src_jsonl", "SELECT item_id, length(text) AS n FROM benchmark")
def src_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = stores.shared_path(spark, "jsonl")
    table(spark, sf, "benchmark").select("item_id", "text").write.json(path)
    return stores.read_json(spark, path, "item_id bigint, text string").select("item_id", F.length("text").cast("long").alias("n"))


@query("src_calendar_file", f"WITH {CALENDAR_SQL} SELECT strftime(d, '%Y-%m-%d') AS d, i FROM cal")
def src_calendar_file(spark: SparkSession, sf: str) -> DataFrame:
    path = stores.shared_path(spark, "calendar")
    stores.write_csv(calendar(spark, sf).select(text_day("d"), C("i").cast("long").alias("i")), path)
    return stores.read_csv(spark, path, "d string, i bigint")


@query("sink_snapshot_upsert", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def sink_snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot, then a corrected version of some rows, written twice: reads give each key's newest version."""
    path = stores.shared_path(spark, "snapshots")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    stores.append_version(c, path, 1)
    fixed = c.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.round(C("c_acctbal") + 1, 2))
    for _ in range(2):
        stores.append_version(fixed, path, 2)
    return stores.current(spark, path, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("sink_bars_batch", f"WITH {BARS_SQL}, cal AS (SELECT DISTINCT d FROM bars) SELECT symbol, count(*) AS n, (SELECT count(*) FROM cal) AS days, round(sum(volume), 2) AS volume FROM bars GROUP BY 1")
def sink_bars_batch(spark: SparkSession, sf: str) -> DataFrame:
    m = stores.columnar(bars(spark, sf), calendar(spark, sf), "volume")
    known = F.filter("values", lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + v)
    return m.select("symbol", F.size(known).cast("long").alias("n"), F.size("values").cast("long").alias("days"), F.round(total, 2).alias("volume"))


@query("scan_remote_bars", f"WITH {BARS_SQL} SELECT symbol, strftime(d, '%Y-%m-%d') AS d, close FROM bars")
def scan_remote_bars(spark: SparkSession, sf: str) -> DataFrame:
    """A columnar batch read as rows."""
    cal = calendar(spark, sf)
    return stores.rows_of(stores.columnar(bars(spark, sf), cal, "close"), cal, "close").select("symbol", text_day("d"), "close")


@query("scan_history", f"WITH {BARS_SQL} SELECT symbol, count(*) AS n, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day FROM bars GROUP BY 1")
def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    g = bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b"))
    return g.select("symbol", "n", text_day("a", "first_day"), text_day("b", "last_day"))


@query("sink_vector_upsert", "SELECT vec_id, sha256(vec_id::VARCHAR || '|' || label::VARCHAR) AS point FROM embeddings WHERE label <> 3")
def sink_vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written under a stable point id, twice, and those of one label deleted by payload."""
    path = stores.shared_path(spark, "vectors")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label", stores.content_hash(C("vec_id"), C("label")).alias("point"))
    for _ in range(2):
        stores.append_version(e, path, 1)
    stores.append_version(e.where("label = 3").withColumn("label", F.lit(None).cast("int")), path, 2)
    return stores.current(spark, path, ["vec_id"]).where("label is not null").select("vec_id", "point")


@query("sink_report_json", f"WITH {MARKET_SQL} SELECT count(*) AS days, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down FROM market")
def sink_report_json(spark: SparkSession, sf: str) -> DataFrame:
    path = stores.shared_path(spark, "report")
    market_days(spark, sf).agg(F.count("*").alias("days"), F.sum("up").alias("up"), F.sum("down").alias("down")).write.json(path)
    return stores.read_json(spark, path, "days bigint, up bigint, down bigint")


# ---- small scalars of quotes


@query("sc_quote_change", f"WITH {BARS_SQL} SELECT symbol, strftime(d, '%Y-%m-%d') AS d, {snap_sql('(close - open) / nullif(open, 0) * 100')} AS change FROM bars")
def sc_quote_change(spark: SparkSession, sf: str) -> DataFrame:
    last, before = F.when(C("close") > 0, C("close")), F.when(C("open") > 0, C("open"))
    return bars(spark, sf).select("symbol", text_day("d"), snap((last - before) / before * 100).alias("change"))


@query("sc_mean_present", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN (p_retailprice + p_size) / 2 END AS mean FROM part")
def sc_mean_present(spark: SparkSession, sf: str) -> DataFrame:
    k = C("p_size") % 3
    a, b = F.when(k != 2, C("p_retailprice")), F.when(k == 1, C("p_size").cast("double"))
    return table(spark, sf, "part").select("p_partkey", mean_present(a, b).alias("mean"))


@query("sc_event_time", f"WITH {CALENDAR_SQL} SELECT strftime(d, '%Y-%m-%d') || ' 09:30' AS opens, strftime(d, '%Y-%m-%d') || ' 15:30' AS closes FROM cal")
def sc_event_time(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda h: F.date_format(F.make_timestamp_ntz(F.year("d"), F.month("d"), F.dayofmonth("d"), F.lit(h), F.lit(30), F.lit(0)), "yyyy-MM-dd HH:mm")
    return calendar(spark, sf).select(at(9).alias("opens"), at(15).alias("closes"))


@query("sc_enrich_reason", f"WITH {STRENGTH_SQL} SELECT sector, printf('%s scores %.2f', sector, score) AS reason FROM sscore")
def sc_enrich_reason(spark: SparkSession, sf: str) -> DataFrame:
    return strength(sector_features(spark, sf)).select("sector", F.format_string("%s scores %.2f", "sector", "score").alias("reason"))


# ---- pipelines


@query("pl_market_context", f"WITH {MARKET_SQL} SELECT strftime(d, '%Y-%m-%d') AS d, {snap_sql('r5')} AS r5, {snap_sql('r20')} AS r20, amount FROM market QUALIFY row_number() OVER (ORDER BY d DESC) = 1")
def pl_market_context(spark: SparkSession, sf: str) -> DataFrame:
    m = market_days(spark, sf).agg(F.max_by(F.struct("d", "r5", "r20", "amount"), "d").alias("x")).select("x.*")
    return m.select(text_day("d"), snap(C("r5")).alias("r5"), snap(C("r20")).alias("r20"), "amount")


@query("pl_regime", f"WITH RECURSIVE {MACHINE_SQL} SELECT strftime(cd.d, '%Y-%m-%d') AS d, cd.regime AS candidate, conf AS confirmed, status FROM sm JOIN cd USING (i) WHERE status <> 'stable'")
def pl_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Scores, probabilities and the confirmation machine over all days: the days on which something moves."""
    days = regime_days(spark, sf)
    m = confirm(days).join(days.select("d", "regime"), "d").where("status <> 'stable'")
    return m.select(text_day("d"), C("regime").alias("candidate"), "confirmed", "status")


@query("pl_stock_analysis", f"WITH {RULES_SQL} SELECT symbol, strftime(d, '%Y-%m-%d') AS d, CAST(CASE WHEN trend THEN 25 ELSE 0 END + CASE WHEN macd_cross THEN 15 ELSE 0 END + CASE WHEN active THEN 10 ELSE 0 END + CASE WHEN market THEN 5 ELSE 0 END AS BIGINT) AS score FROM e WHERE n >= 260 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1 ORDER BY score DESC, symbol LIMIT 10")
def pl_stock_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The ten symbols whose latest bar scores best by the rules (the limit is the report's)."""
    return rule_scan(spark, sf).orderBy(F.desc("score"), "symbol").limit(10)


@query("pl_backfill", f"WITH {BARS_SQL}, r AS (SELECT symbol, d, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r5 FROM bars) SELECT strftime(d, '%Y-%m-%d') AS d, count(r5) AS n, {snap_sql('median(r5)')} AS median_r5 FROM r GROUP BY d")
def pl_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Features of every past day in one query."""
    return bars(spark, sf).select("d", change(C("close"), 5).alias("r5")).groupBy("d").agg(F.count("r5").alias("n"), snap(F.median("r5")).alias("median_r5")).select(text_day("d"), "n", "median_r5")


@query("ind_profile", f"WITH {BARS_SQL}, x AS (SELECT symbol, d, n, close, max(n) OVER (PARTITION BY symbol) AS total, CASE WHEN n >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS ma20 FROM bars) SELECT symbol, strftime(d, '%Y-%m-%d') AS d, {snap_sql('ma20', 4)} AS close__ma20, close > ma20 AS above FROM x WHERE total >= 260")
def ind_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A profile of indicators for the symbols with at least 260 bars."""
    b = bars(spark, sf).withColumn("total", F.count("*").over(Window.partitionBy("symbol"))).withColumn("ma20", rolling_mean(C("close"), 20))
    return b.where("total >= 260").select("symbol", text_day("d"), snap(C("ma20"), 4).alias("close__ma20"), (C("close") > C("ma20")).alias("above"))


@query("tk_daily_scan", f"WITH {STRENGTH_SQL} SELECT sector, score FROM sscore QUALIFY row_number() OVER (ORDER BY score DESC, sector) <= 2")
def tk_daily_scan(spark: SparkSession, sf: str) -> DataFrame:
    return strength(sector_features(spark, sf)).where("rank <= 2").select("sector", "score")
