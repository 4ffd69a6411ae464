"""Joins: decisions and outcomes, membership and statements at a time, recall branches, state against state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.parsing import statutory_deadline
from marlstone.operators import vectors
from marlstone.operators.joins import as_of, in_force, intervals_of, latest_per
from marlstone.operators.ordering import ranked
from marlstone.operators.retrieval import dense_top_k
from marlstone.registry import query
from marlstone.sources.tables import BARS_SQL, DECISIONS_SQL, MEMBERSHIP_SQL, bars, decisions, membership, table

C = F.col


def text_day(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


@query("jn_decision_outcome", f"WITH {DECISIONS_SQL}, o AS (SELECT l_orderkey AS decision_id, sum(l_quantity) AS filled, count(*) AS n FROM lineitem GROUP BY 1) SELECT decision_id, regime, strategy, horizon, excess, filled, n FROM decision JOIN o USING (decision_id) WHERE excess IS NOT NULL AND regime IS NOT NULL")
def jn_decision_outcome(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("decision_id")).agg(F.sum("l_quantity").alias("filled"), F.count("*").alias("n"))
    d = decisions(spark, sf).where("excess is not null and regime is not null").select("decision_id", "regime", "strategy", "horizon", "excess")
    return d.join(o, "decision_id")


@query("jn_membership_asof", f"WITH {BARS_SQL}, {MEMBERSHIP_SQL} SELECT b.symbol, strftime(d, '%Y-%m-%d') AS d, close, sector FROM bars b JOIN member m ON b.symbol = m.symbol AND valid_from <= d AND (valid_to IS NULL OR valid_to >= d)")
def jn_membership_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The sector of every bar by the intervals of its symbol: an equality join on the symbol, which Spark broadcasts or
    shuffles by the intervals' size."""
    b = bars(spark, sf).select("symbol", "d", "close")
    return in_force(b, membership(spark, sf), "symbol", "d").select("symbol", text_day("d"), "close", "sector")


_OBS_SQL = "obs AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(C("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d")).agg(F.max("l_returnflag").alias("flag"))


@query("jn_scd2_build", f"WITH {_OBS_SQL}, c AS (SELECT *, lag(flag) OVER (PARTITION BY symbol ORDER BY d) AS before FROM obs), k AS (SELECT * FROM c WHERE before IS NULL OR before <> flag) SELECT symbol, flag, strftime(d, '%Y-%m-%d') AS valid_from, strftime(lead(d) OVER (PARTITION BY symbol ORDER BY d) - 1, '%Y-%m-%d') AS valid_to FROM k")
def jn_scd2_build(spark: SparkSession, sf: str) -> DataFrame:
    return intervals_of(observations(spark, sf), "symbol", "d", "flag").select("symbol", "flag", text_day("valid_from"), text_day("valid_to"))


STATEMENTS_SQL = """st0 AS (SELECT o_custkey AS symbol, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS period_end, round(sum(o_totalprice), 2) AS revenue, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN k % 3 = 0 THEN CASE quarter(period_end) WHEN 1 THEN make_date(year(period_end), 4, 30) WHEN 2 THEN make_date(year(period_end), 8, 31) WHEN 3 THEN make_date(year(period_end), 10, 31) ELSE make_date(year(period_end) + 1, 4, 30) END ELSE (period_end + (20 + k % 60)::INT)::DATE END AS disclosed FROM st0)"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly figures of customers; a third has no announcement and falls back to the legal deadline."""
    quarter = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    s = table(spark, sf, "orders").groupBy(C("o_custkey").alias("symbol"), quarter.alias("period_end")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n"), F.max("o_orderkey").alias("k")
    )
    announced = F.when(C("k") % 3 != 0, F.date_add("period_end", (20 + C("k") % 60).cast("int")))
    return s.withColumn("disclosed", F.coalesce(announced, statutory_deadline(C("period_end"))))


@query("jn_pit_asof", f"WITH {STATEMENTS_SQL}, q AS (SELECT c_custkey AS symbol, d FROM customer, (VALUES (DATE '1996-05-01'), (DATE '1997-09-15'), (DATE '1999-01-31')) v(d)) SELECT q.symbol, strftime(d, '%Y-%m-%d') AS d, strftime(max(period_end), '%Y-%m-%d') AS period_end, arg_max(revenue, (period_end, disclosed)) AS revenue, arg_max(n, (period_end, disclosed)) AS n FROM q LEFT JOIN st ON st.symbol = q.symbol AND disclosed <= d GROUP BY ALL")
def jn_pit_asof(spark: SparkSession, sf: str) -> DataFrame:
    days = F.explode(F.array(*(F.lit(x).cast("date") for x in ("1996-05-01", "1997-09-15", "1999-01-31"))))
    asked = table(spark, sf, "customer").select(C("c_custkey").alias("symbol"), days.alias("d"))
    out = as_of(asked, statements(spark, sf), "symbol", "d", "disclosed", ["period_end", "disclosed"], ["period_end", "revenue", "n"])
    return out.select("symbol", text_day("d"), text_day("period_end"), "revenue", "n")


#: Fields that are forecasts and have no disclosure day (fixed values).
FORECASTS = ("eps_forecast", "net_profit_forecast", "revenue_forecast", "target_price", "analyst_rating", "forecast_count")


@query("jn_fundamental_panel", f"WITH {STATEMENTS_SQL}, q AS (SELECT c_custkey AS symbol, d FROM customer, (SELECT unnest(generate_series(DATE '1997-01-15', DATE '1997-12-15', INTERVAL 1 MONTH))::DATE AS d)) SELECT q.symbol, strftime(d, '%Y-%m-%d') AS d, arg_max(revenue, (period_end, disclosed)) AS revenue FROM q LEFT JOIN st ON st.symbol = q.symbol AND disclosed <= d GROUP BY ALL")
def jn_fundamental_panel(spark: SparkSession, sf: str) -> DataFrame:
    days = F.explode(F.expr("sequence(date'1997-01-15', date'1997-12-15', interval 1 month)"))
    asked = table(spark, sf, "customer").select(C("c_custkey").alias("symbol"), days.alias("d"))
    s = statements(spark, sf)
    fields = [f for f in ("revenue", "target_price") if f not in FORECASTS]
    return as_of(asked, s, "symbol", "d", "disclosed", ["period_end", "disclosed"], fields).select("symbol", text_day("d"), *fields)


WINDOWS_SQL = "dw AS (SELECT o_orderkey AS decision_id, o_custkey % 100 + 1 AS symbol, CAST(o_orderdate AS DATE) AS entry, (CAST(o_orderdate AS DATE) + (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 20 END)::INT)::DATE AS exit FROM orders)"


def windows(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey") % 3
    entry = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        C("o_orderkey").alias("decision_id"), (C("o_custkey") % 100 + 1).alias("symbol"), entry.alias("entry"), F.date_add(entry, F.when(k == 0, 1).when(k == 1, 5).otherwise(20)).alias("exit")
    )


@query("jn_price_at", f"WITH {BARS_SQL}, {WINDOWS_SQL} SELECT decision_id, dw.symbol, any_value(e.open) AS entry_price, arg_max(x.close, x.d) AS exit_price, strftime(max(x.d), '%Y-%m-%d') AS exit_day FROM dw LEFT JOIN bars e ON e.symbol = dw.symbol AND e.d = dw.entry LEFT JOIN bars x ON x.symbol = dw.symbol AND x.d <= dw.exit GROUP BY 1, 2")
def jn_price_at(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("symbol", "d", "open", "close")
    w = windows(spark, sf).join(b.select("symbol", C("d").alias("entry"), C("open").alias("entry_price")), ["symbol", "entry"], "left")
    out = as_of(w, b.select("symbol", C("d").alias("exit_day"), C("close").alias("exit_price"), "d"), "symbol", "exit", "d", ["d"], ["exit_day", "exit_price"])
    return out.select("decision_id", "symbol", "entry_price", "exit_price", text_day("exit_day"))


@query("jn_ffill_calendar", f"WITH {BARS_SQL}, cal AS (SELECT DISTINCT d FROM bars), s AS (SELECT DISTINCT symbol FROM bars), g AS (SELECT s.symbol, cal.d FROM s CROSS JOIN cal) SELECT g.symbol, strftime(g.d, '%Y-%m-%d') AS d, bars.close FROM g ASOF LEFT JOIN bars ON bars.symbol = g.symbol AND bars.d <= g.d")
def jn_ffill_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Last known close of every symbol on every trading day of the calendar."""
    b = bars(spark, sf).select("symbol", "d", "close")
    calendar = b.agg(F.array_sort(F.collect_set("d")).alias("days"))  # a row of trading days
    asked = b.select("symbol").distinct().join(F.broadcast(calendar)).select("symbol", F.explode("days").alias("d"))
    return as_of(asked, b.withColumnRenamed("d", "t"), "symbol", "d", "t", ["t"], ["close"]).select("symbol", text_day("d"), "close")


@query("jn_latest_per_parent", "SELECT c_custkey, o.o_orderkey AS latest_order, e.event_id AS latest_event FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1) e ON user_id = c_custkey")
def jn_latest_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    o = latest_per(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    e = latest_per(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    c = table(spark, sf, "customer").select("c_custkey")
    out = c.join(o, c.c_custkey == o.o_custkey, "left").join(e, c.c_custkey == e.user_id, "left")
    return out.select("c_custkey", C("o_orderkey").alias("latest_order"), C("event_id").alias("latest_event"))


@query("jn_execution_chain", "SELECT o_orderkey AS intent_id, count(l_orderkey) AS fills, coalesce(sum(l_quantity), 0) AS filled, o_orderstatus AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 4")
def jn_execution_chain(spark: SparkSession, sf: str) -> DataFrame:
    intents = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(C("o_orderkey").alias("intent_id"), C("o_orderstatus").alias("status"))
    fills = table(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("intent_id")).agg(F.count("*").alias("fills"), F.sum("l_quantity").alias("filled"))
    out = intents.join(fills, "intent_id", "left")
    return out.select("intent_id", F.coalesce("fills", F.lit(0)).alias("fills"), F.coalesce("filled", F.lit(0.0)).alias("filled"), "status")


_DENSE = "SELECT doc_id AS chunk_id, round((doc_id * 7 % 101) / 101.0, 6) AS score FROM documents WHERE lang <> 'fr'"
_SPARSE = "SELECT doc_id AS chunk_id, round((doc_id * 13 % 97) / 97.0, 6) AS score FROM documents WHERE n_chars >= 800"


def recall_branches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k, d = C("doc_id"), table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    dense = d.where("lang <> 'fr'").select(k.alias("chunk_id"), F.round((k * 7 % 101) / 101.0, 6).alias("score"))
    return dense, d.where("n_chars >= 800").select(k.alias("chunk_id"), F.round((k * 13 % 97) / 97.0, 6).alias("score"))


@query("jn_recall_merge", f"SELECT coalesce(d.chunk_id, s.chunk_id) AS chunk_id, coalesce(d.score, s.score) AS score, d.score AS dense_score, s.score AS sparse_score, CASE WHEN d.chunk_id IS NULL THEN 'sparse' WHEN s.chunk_id IS NULL THEN 'dense' ELSE 'dense,sparse' END AS sources FROM ({_DENSE}) d FULL JOIN ({_SPARSE}) s ON d.chunk_id = s.chunk_id")
def jn_recall_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge_recall(*recall_branches(spark, sf))


def merge_recall(dense: DataFrame, sparse: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Both branches' hits once each; the dense branch's score goes first, sources are united."""
    d = dense.select(key, C("score").alias("dense_score"))
    s = sparse.select(key, C("score").alias("sparse_score"))
    sources = F.array_join(F.array_compact(F.array(F.when(C("dense_score").isNotNull(), "dense"), F.when(C("sparse_score").isNotNull(), "sparse"))), ",")
    return d.join(s, key, "full").select(key, F.coalesce("dense_score", "sparse_score").alias("score"), "dense_score", "sparse_score", sources.alias("sources"))


@query("jn_hydrate", f"SELECT chunk_id, score, lang, source, n_chars FROM ({_DENSE}) h LEFT JOIN (SELECT * FROM documents WHERE source <> 'src3') d ON doc_id = chunk_id")
def jn_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    dense, _ = recall_branches(spark, sf)
    d = table(spark, sf, "documents").where("source <> 'src3'").select(C("doc_id").alias("chunk_id"), "lang", "source", "n_chars")
    return dense.join(d, "chunk_id", "left").select("chunk_id", "score", "lang", "source", "n_chars")


@query("jn_memory_vector", "SELECT d.doc_id, source, quality FROM documents d JOIN labels l USING (doc_id) WHERE lang = 'en' AND quality = 1 ORDER BY n_chars DESC, doc_id LIMIT 50")
def jn_memory_vector(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    j = d.join(table(spark, sf, "labels").where("quality = 1").select("doc_id", "quality"), "doc_id")
    return j.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "source", "quality")


@query("jn_symbol_state", "SELECT coalesce(p.symbol, c.symbol) AS symbol, p.score, coalesce(c.weight, 0) AS weight, coalesce(p.theme, c.theme) AS theme FROM (SELECT p_partkey AS symbol, p_brand AS theme, p_size::DOUBLE AS score FROM part WHERE p_size > 25) p FULL JOIN (SELECT c_custkey AS symbol, c_mktsegment AS theme, round(c_acctbal / 1e5, 4) AS weight FROM customer WHERE c_acctbal > 0) c ON p.symbol = c.symbol")
def jn_symbol_state(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_size > 25").select(C("p_partkey").alias("symbol"), C("p_brand").alias("t1"), C("p_size").cast("double").alias("score"))
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("symbol"), C("c_mktsegment").alias("t2"), F.round(C("c_acctbal") / 1e5, 4).alias("weight"))
    return p.join(c, "symbol", "full").select("symbol", "score", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("t1", "t2").alias("theme"))


@query("jn_alpha_merge", "WITH a AS (SELECT p_partkey AS symbol, p_retailprice AS alpha, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER () AS n FROM part WHERE p_retailprice > 1000) SELECT p_partkey AS symbol, p_size AS base, alpha, coalesce(k <= greatest(1, n // 10), false) AS top_alpha FROM part LEFT JOIN a ON symbol = p_partkey")
def jn_alpha_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.where("p_retailprice > 1000").select(C("p_partkey").alias("symbol"), C("p_retailprice").alias("alpha"))
    n = a.agg(F.count("*").alias("n"))
    a = ranked(a, F.desc("alpha"), C("symbol")).join(F.broadcast(n))
    out = p.select(C("p_partkey").alias("symbol"), C("p_size").alias("base")).join(a, "symbol", "left")
    return out.select("symbol", "base", "alpha", F.coalesce(C("rank") <= F.greatest(F.lit(1), F.floor(C("n") / 10)), F.lit(False)).alias("top_alpha"))


@query("jn_replay_diff", "WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS action FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS action FROM orders WHERE o_totalprice > 100000) SELECT coalesce(a.id, b.id) AS id, a.action AS stored, b.action AS replayed FROM a FULL JOIN b ON a.id = b.id WHERE a.action IS DISTINCT FROM b.action")
def jn_replay_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(C("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    a = o.where("o_orderpriority <> '5-LOW'").select("id", C("o_orderstatus").alias("stored"))
    b = o.where("o_totalprice > 100000").select("id", F.when(C("id") % 7 == 0, "X").otherwise(C("o_orderstatus")).alias("replayed"))
    return a.join(b, "id", "full").where(~C("stored").eqNullSafe(C("replayed")))


@query("jn_reconcile", "WITH l AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), b AS (SELECT l_suppkey AS symbol, sum(l_quantity) + CASE WHEN l_suppkey % 4 = 0 THEN 5 ELSE 0 END AS qty FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 9 <> 0 GROUP BY 1) SELECT coalesce(l.symbol, b.symbol) AS symbol, coalesce(l.qty, 0) AS local_qty, coalesce(b.qty, 0) AS broker_qty, CASE WHEN b.symbol IS NULL THEN 'MISSING_AT_BROKER' WHEN l.symbol IS NULL THEN 'MISSING_LOCALLY' ELSE 'QUANTITY' END AS kind FROM l FULL JOIN b ON l.symbol = b.symbol WHERE abs(coalesce(l.qty, 0) - coalesce(b.qty, 0)) > 0.5")
def jn_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(C("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").alias("qty"))
    local = held.select("symbol", C("qty").alias("local_qty"))
    broker = held.where("symbol % 9 <> 0").select("symbol", (C("qty") + F.when(C("symbol") % 4 == 0, 5).otherwise(0)).alias("broker_qty"))
    kind = F.when(C("broker_qty").isNull(), "MISSING_AT_BROKER").when(C("local_qty").isNull(), "MISSING_LOCALLY").otherwise("QUANTITY")
    both = local.join(broker, "symbol", "full").withColumn("kind", kind).fillna(0.0, ["local_qty", "broker_qty"])
    return both.where(F.abs(C("local_qty") - C("broker_qty")) > 0.5).select("symbol", "local_qty", "broker_qty", "kind")


@query("jn_membership_coverage", f"WITH {MEMBERSHIP_SQL} SELECT count(DISTINCT l_suppkey) FILTER (l_suppkey IN (SELECT symbol FROM member WHERE valid_from <= DATE '1998-06-01' AND (valid_to IS NULL OR valid_to >= DATE '1998-06-01') AND sector LIKE '%A%')) AS covered, count(DISTINCT l_suppkey) AS asked FROM lineitem")
def jn_membership_coverage(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "lineitem").select(C("l_suppkey").alias("symbol")).distinct()
    day = F.lit("1998-06-01").cast("date")
    known = membership(spark, sf).where((C("valid_from") <= day) & (C("valid_to").isNull() | (C("valid_to") >= day)) & C("sector").contains("A"))
    hit = asked.join(known.select("symbol").distinct().withColumn("hit", F.lit(1)), "symbol", "left")
    return hit.agg(F.count("hit").alias("covered"), F.count("*").alias("asked"))


@query("jn_theme_cluster", "SELECT p_partkey AS symbol, p_brand AS theme, coalesce(CASE WHEN p_partkey % 10 = 0 THEN 'c' || (p_partkey % 3)::VARCHAR END, CASE WHEN p_brand LIKE '%1' THEN 'ones' WHEN p_brand LIKE '%2' THEN 'twos' END) AS cluster FROM part")
def jn_theme_cluster(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(C("p_partkey").alias("symbol"), C("p_brand").alias("theme"))
    by_symbol = p.where("symbol % 10 = 0").select("symbol", F.concat(F.lit("c"), (C("symbol") % 3).cast("string")).alias("own"))
    tail = F.when(C("theme").endswith("1"), "ones").when(C("theme").endswith("2"), "twos")
    by_theme = p.select("theme").distinct().select("theme", tail.alias("general"))
    return p.join(by_symbol, "symbol", "left").join(by_theme, "theme", "left").select("symbol", "theme", F.coalesce("own", "general").alias("cluster"))


@query("jn_request_cache", "WITH r AS (SELECT event_id, event_type AS tool, md5(event_type || '|' || (user_id % 20)::VARCHAR) AS request, value, ts FROM events) SELECT tool, request, arg_max(value, (ts, event_id)) AS value, count(*) AS hits FROM r GROUP BY 1, 2")
def jn_request_cache(spark: SparkSession, sf: str) -> DataFrame:
    request = F.md5(F.concat_ws("|", "event_type", (C("user_id") % 20).cast("string")).cast("binary"))
    r = table(spark, sf, "events").select(C("event_type").alias("tool"), request.alias("request"), "value", "ts", "event_id")
    return r.groupBy("tool", "request").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("hits"))


_DOT = "list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("jn_dense_topk", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def jn_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), "embedding")
    return dense_top_k(asked, e.select("vec_id", "embedding"), 10)


@query("jn_vector_index", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def jn_vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same by inverted lists: eight lists a query, then those that bounds leave open, so that the result is exact."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), "embedding")
    return vectors.search(asked, vectors.build(e), 10, exact=True)


@query("jn_vector_probe")
def jn_vector_probe(spark: SparkSession, sf: str) -> DataFrame:
    """As many of the nearest lists as a recall of 0.95 takes by measure: not exact, see the test of its recall."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), "embedding")
    index = vectors.build(e)
    return vectors.search(asked, index, 10, probes=vectors.probes_for(e, index, 10))


# ---- sets


@query("set_union_first", "WITH u AS (SELECT unnest(['b', 'a', 'c', o_orderstatus, o_orderpriority[1]]) AS x, o_custkey FROM orders) SELECT o_custkey, array_to_string(list_sort(list_distinct(list(x))), ',') AS tags FROM u GROUP BY 1")
def set_union_first(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.lit("b"), F.lit("a"), F.lit("c"), C("o_orderstatus"), F.substring("o_orderpriority", 1, 1))
    o = table(spark, sf, "orders").select("o_custkey", F.explode(tags).alias("x"))
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("tags"))  # at most a value for each status and priority


@query("set_difference", "SELECT 'only_a' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'only_b', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a, b = (o.where(C("o_orderstatus") == s).select("o_custkey") for s in ("F", "O"))
    count = lambda x, name: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(a.subtract(b), "only_a").unionByName(count(b.subtract(a), "only_b"))


# ---- sessions of a calendar

CALENDAR_SQL = "cal AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem))"


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days with their session number. One row a day: a century has 40,000."""
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return days.withColumn("i", F.row_number().over(Window.orderBy("d")))


@query("dt_session", f"WITH {CALENDAR_SQL}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT q.d, max(cal.i) AS i FROM q LEFT JOIN cal ON cal.d <= q.d GROUP BY 1) SELECT strftime(p.d, '%Y-%m-%d') AS d, exists(SELECT 1 FROM cal WHERE cal.d = p.d) AS is_open, strftime(a.d, '%Y-%m-%d') AS session, strftime(n.d, '%Y-%m-%d') AS next_session, strftime(t.d, '%Y-%m-%d') AS in_five FROM p LEFT JOIN cal a ON a.i = p.i LEFT JOIN cal n ON n.i = p.i + 1 LEFT JOIN cal t ON t.i = p.i + 5")
def dt_session(spark: SparkSession, sf: str) -> DataFrame:
    cal = calendar(spark, sf)
    asked = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    one = lambda df: df.withColumn("_all", F.lit(0))  # noqa: E731  one calendar
    known = one(cal.select(C("d").alias("session"), "i", C("d").alias("t")))
    at = as_of(one(asked), known, "_all", "d", "t", ["t"], ["session", "i"])
    at = at.withColumn("is_open", F.coalesce(C("session") == C("d"), F.lit(False)))
    step = lambda k, name: F.broadcast(cal.select((C("i") - k).alias("i"), C("d").alias(name)))
    out = at.join(step(1, "next_session"), "i", "left").join(step(5, "in_five"), "i", "left")
    return out.select(text_day("d"), "is_open", text_day("session"), text_day("next_session"), text_day("in_five"))


@query("dt_market_clock", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local, hour(ts + INTERVAL 8 HOUR) >= 16 AS after_close, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE) + CASE WHEN hour(ts + INTERVAL 8 HOUR) >= 16 THEN 1 ELSE 0 END, '%Y-%m-%d') AS usable_from FROM events")
def dt_market_clock(spark: SparkSession, sf: str) -> DataFrame:
    local = F.from_utc_timestamp("ts", "Asia/Shanghai")
    e = table(spark, sf, "events").select("event_id", local.alias("local"))
    late = F.hour("local") >= 16
    return e.select("event_id", F.date_format("local", "yyyy-MM-dd HH:mm").alias("local"), late.alias("after_close"), F.date_format(F.date_add(F.to_date("local"), late.cast("int")), "yyyy-MM-dd").alias("usable_from"))


@query("dt_horizons", f"WITH {CALENDAR_SQL}, h AS (SELECT o_orderkey AS decision_id, CAST(o_orderdate AS DATE) AS d, unnest([1, 5, 20]) AS horizon FROM orders), dd AS (SELECT d, (SELECT max(i) FROM cal WHERE cal.d <= x.d) AS i FROM (SELECT DISTINCT d FROM h) x), a AS (SELECT h.*, i FROM h JOIN dd USING (d)) SELECT decision_id, horizon, strftime(cal.d, '%Y-%m-%d') AS due FROM a LEFT JOIN cal ON cal.i = a.i + horizon")
def dt_horizons(spark: SparkSession, sf: str) -> DataFrame:
    """Due sessions of each decision at its horizons."""
    cal = calendar(spark, sf)
    d = table(spark, sf, "orders").select(C("o_orderkey").alias("decision_id"), F.to_date("o_orderdate").alias("d"))
    known = cal.select(C("d").alias("t"), "i", F.lit(0).alias("_all"))
    days = as_of(d.select("d").distinct().withColumn("_all", F.lit(0)), known, "_all", "d", "t", ["t"], ["i"]).select("d", "i")
    h = d.join(F.broadcast(days), "d").select("decision_id", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))).alias("horizon"), "i")
    due = h.withColumn("i", C("i") + C("horizon")).join(F.broadcast(cal), "i", "left")
    return due.select("decision_id", "horizon", text_day("d", "due"))
