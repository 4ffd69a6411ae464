"""Nulls, short series, ties and folds, against plain Python."""

import random
import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import parsing, prices, scores
from marlstone.functions.series import full, path_drawdown, rolling_mean, smoothed
from marlstone.operators import backtest, joins, ordering, portfolio, regimes, retrieval, rules
from marlstone.sources import stores
from marlstone.streaming import ticks

ROOT = Path(__file__).parents[1]


def one(spark, column, **values):
    """The value of ``column`` over one row of texts, numbers or nulls."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def series(spark, values, symbol=1):
    return spark.createDataFrame([(symbol, date(2020, 1, 1) + timedelta(days=k), v) for k, v in enumerate(values)], "symbol long, d date, close double")


# ---- packaging


def test_import_needs_no_session_and_no_llm():
    code = "import sys, __spark_entry__ as e; e.queries(); e.oracle_sql(); import marlstone.plans"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_but_the_entry_imports_llm():
    for f in (ROOT / "marlstone").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "marlstone").parts:
            assert "marlstone.llm" not in f.read_text(), f


# ---- series


@pytest.mark.parametrize("n", [1, 4, 5, 30])
def test_rolling_needs_full_windows(spark, n):
    r = random.Random(n)
    values = [r.uniform(1, 9) for _ in range(n)]
    got = [x.m for x in series(spark, values).select("d", rolling_mean(F.col("close"), 5).alias("m")).orderBy("d").collect()]
    want = pd.Series(values).rolling(5).mean().tolist()
    assert all((g is None and w != w) or abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True))


def test_rolling_over_nulls(spark):
    got = [x.m for x in series(spark, [1.0, None, 3.0, 4.0, 5.0]).select("d", full(F.col("close"), 3, F.avg).alias("m")).orderBy("d").collect()]
    assert got == [None, None, None, None, 4.0]


@pytest.mark.parametrize("alpha", [2 / 13, 2 / 27, 1 / 3])
def test_smoothing_equals_ewm(spark, alpha):
    r = random.Random(3)
    values = [100 + r.gauss(0, 5) for _ in range(300)]
    index = F.row_number().over(Window.partitionBy("symbol").orderBy("d")) - 1
    df = series(spark, values).withColumn("i", index)
    got = [x.y for x in df.select("d", smoothed(F.col("close"), alpha, F.col("i")).alias("y")).orderBy("d").collect()]
    want = pd.Series(values).ewm(alpha=alpha, adjust=False).mean().tolist()
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_path_drawdown(spark):
    assert one(spark, path_drawdown(F.array(*map(F.lit, (4.0, 5.0, 2.0, 6.0, 3.0))))) == pytest.approx(-0.6)
    assert one(spark, path_drawdown(F.array(F.lit(1.0)))) is None


# ---- scalars


def test_parsing(spark):
    assert one(spark, parsing.safe_float(F.col("x")), x="1,234.5") == 1234.5
    assert one(spark, parsing.optional_float(F.col("x")), x="12%") == 12.0
    assert one(spark, parsing.optional_float(F.col("x")), x="") is None
    assert one(spark, parsing.parse_date(F.col("x")), x="2024/02/30") is None
    assert one(spark, parsing.parse_date(F.col("x")), x="20240229") == date(2024, 2, 29)
    assert one(spark, parsing.statutory_deadline(F.lit("2020-12-31").cast("date"))) == date(2021, 4, 30)
    assert one(spark, parsing.statutory_deadline(F.lit("2020-10-31").cast("date"))) == date(2021, 2, 28)
    assert one(spark, parsing.parse_price(F.col("x")), x="inf").status == "INVALID"


def test_prices(spark):
    assert one(spark, prices.round_to_tick(F.lit(10.005), F.lit(0.01))) == 10.01
    up, down = prices.limit_prices(F.lit(10.0), F.lit(0.1), F.lit(0.01))
    assert (one(spark, up), one(spark, down)) == (11.0, 9.0)
    assert one(spark, prices.limit_prices(F.lit(10.0), F.lit(None).cast("double"), F.lit(0.01))[0]) == float("inf")
    assert one(spark, prices.suspended(F.lit(float("nan")))) is True
    assert one(spark, prices.trade_cost(F.lit(1000.0), F.lit(True))) == pytest.approx(5 + 0.5 + 1)


def test_scores_keep_nulls(spark):
    null = F.lit(None).cast("double")
    assert one(spark, scores.clip(null, 0, 1)) is None
    assert one(spark, scores.range_bound(null, F.lit(0.5))) is None
    assert one(spark, scores.breadth(F.lit(0), F.lit(0))) == 0.5
    assert one(spark, scores.ratio(F.lit(3.0), F.lit(0.0))) is None
    s = dict.fromkeys(("retreat", "drawdown", "breadth", "crowding", "range", "rotation"), null)
    assert one(spark, scores.most_likely(scores.regime_probabilities(s))["name"]) == "UNKNOWN"


# ---- rules


def test_rules_are_three_valued(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1), None, 2.0), (1, date(2020, 1, 2), 3.0, 2.0)], "symbol long, d date, a double, b double")
    get = lambda e: [r.x for r in df.select("d", rules.compile_rule(e, {"m": {"x": 1}}).alias("x")).orderBy("d").collect()]
    assert get({"gt": ["a", "b"]}) == [None, True]
    assert get({"any": [{"gt": ["a", "b"]}, {"gt": ["b", 1]}]}) == [True, True]
    assert get({"all": [{"gt": ["a", "b"]}, {"lt": ["b", 1]}]}) == [False, False]
    assert get({"cross_up": ["a", "b"]}) == [False, False]
    assert get({"context_gte": ["m.x", 1]}) == [True, True] and get({"context_gte": ["m.y", 1]}) == [None, None]


def test_rule_problems():
    pack = rules.RulePack("p", {"a": ({"gt": ["close"]}, 10), "b": ({"nope": [1]}, 10), "c": ({"gt": ["missing", 1]}, 120)}, "1.0")
    found = rules.problems(pack, {"close"})
    assert len(found) == 5
    assert rules.problems(rules.RulePack("p", {"a": ({"gt": ["close", 1]}, 10)}), {"close"}) == []


# ---- joins and order


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 10, "x"), ("a", 4, 9, "y"), ("a", 6, 11, "z")], "k string, u long, period long, v string")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", "u", ["period"], ["v"]).collect()}
    assert got == {("a", 5): "x", ("a", 1): None, ("b", 9): None, (None, 3): None}


def test_intervals(spark):
    obs = spark.createDataFrame([(1, date(2020, 1, k), s) for k, s in ((1, "a"), (2, "a"), (5, "b"), (9, "a"))], "k long, d date, s string")
    got = [tuple(r) for r in joins.intervals_of(obs, "k", "d", "s").orderBy("valid_from").collect()]
    assert got == [(1, "a", date(2020, 1, 1), date(2020, 1, 4)), (1, "b", date(2020, 1, 5), date(2020, 1, 8)), (1, "a", date(2020, 1, 9), None)]
    days = spark.createDataFrame([(1, date(2020, 1, 4)), (1, date(2020, 1, 9))], "k long, at date")
    held = joins.in_force(days, joins.intervals_of(obs, "k", "d", "s"), "k", "at").collect()
    assert sorted(r.s for r in held) == ["a", "a"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_and_running_max_over_partitions(spark, partitions):
    r = random.Random(1)
    values = [(k, r.randint(0, 500)) for k in range(2000)]
    df = spark.createDataFrame(values, "id long, v long").repartition(partitions)
    got = {x.id: x["rank"] for x in ordering.ranked(df, F.desc("v"), F.col("id")).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])), 1)}
    top, want = None, {}
    for i, v in values:
        want[i] = top
        top = v if top is None else max(top, v)
    assert {x.id: x.m for x in ordering.running_max_before(df, "v", "m", F.col("id")).collect()} == want


# ---- folds


def test_fold_streams_keys_in_order(spark):
    rows = [(k % 5, t, k) for t in range(40) for k in range(20)]
    df = spark.createDataFrame(rows, "key long, t long, v long").repartition(6)
    out = ordering.fold(df, "key", ["t", "v"], lambda k: [0], lambda s, r: [(int(r["key"].iloc[0]), int(r["t"].iloc[0]), s.__setitem__(0, s[0] + int(r["v"].sum())) or s[0])], "key long, t long, total long")
    got = {(r.key, r.t): r.total for r in out.collect()}
    want, total = {}, dict.fromkeys(range(5), 0)
    for t in range(40):
        for key in range(5):
            total[key] += sum(k for k in range(20) if k % 5 == key)
            want[key, t] = total[key]
    assert got == want


def test_backtest_equals_a_plain_loop(spark):
    """Whole lots, costs, next-day selling and limits, on a small panel, against a loop over dictionaries."""
    r = random.Random(8)
    days, symbols = 30, range(1, 7)
    price = {s: 10.0 * s for s in symbols}
    rows = []
    for t in range(days):
        for s in symbols:
            close = round(price[s] * (1 + r.uniform(-0.12, 0.12)), 2)
            rows.append((1, s, date(2020, 1, 1) + timedelta(days=t), t, r.random() if r.random() > 0.1 else None, price[s], close, 0.0 if r.random() < 0.1 else 100.0, 2, 3))
            price[s] = close
    schema = "strategy long, symbol long, d date, day long, score double, price double, close double, volume double, top_k int, interval int"
    panel = backtest.prepared(spark.createDataFrame(rows, schema), F.lit(0.10), "strategy")
    got = [(x.equity, len(x.trades)) for x in backtest.run_top_k(panel, 100_000.0).orderBy("d").collect()]

    cash, lots, last, want = 100_000.0, {}, {}, []
    half_up = lambda x: int(x * 100 + 0.5 + 1e-9) / 100
    for t in range(days):
        today = {x[1]: x for x in rows if x[3] == t}
        before = {x[1]: x[6] for x in rows if x[3] == t - 1}
        for s, x in today.items():
            last[s] = x[6]
        n = 0
        held = lambda s: sum(q for q, _ in lots.get(s, []))
        if t % 3 == 0:
            trades = {s: x[7] > 0 for s, x in today.items()}
            buys = {s: s not in before or x[5] < half_up(before[s] * 1.1) for s, x in today.items()}
            sells = {s: s not in before or x[5] > half_up(before[s] * 0.9) for s, x in today.items()}

            def sell(s, q, t=t, today=today):
                nonlocal cash, n
                q = min(q, sum(a for a, b in lots[s] if b < t))
                if q <= 0:
                    return
                rest, left = [], q
                for a, b in lots[s]:
                    x = min(a, left) if b < t else 0
                    left -= x
                    if a - x > 1e-9:
                        rest.append((a - x, b))
                lots[s] = rest
                v = q * today[s][5]
                cash += v - max(v * 0.00025, 5) - v * 0.0015
                n += 1

            order = sorted((s for s, x in today.items() if trades[s] and x[4] is not None), key=lambda s: (-today[s][4], s))
            target = [s for s in order if buys[s] or held(s) > 1e-9][:2]
            for s in sorted(lots):
                if s not in target and held(s) > 1e-9 and trades[s] and sells[s]:
                    sell(s, held(s))
            if target:
                each = 0.99 * (cash + sum(held(s) * today[s][5] for s in lots)) / len(target)
                for s in target:
                    excess = held(s) * today[s][5] - each
                    if excess > 1 and sells[s] and s in lots:
                        sell(s, excess / today[s][5])
                for s in target:
                    gap, p = each - held(s) * today[s][5], today[s][5]
                    if gap <= 1 or not buys[s]:
                        continue
                    cost = lambda v: max(v * 0.00025, 5) + v * 0.001
                    v = min(gap, cash)
                    for _ in range(2):
                        if v + cost(v) > cash + 1e-9:
                            v = max(cash - cost(v), 0)
                    q = int(v / p / 100) * 100
                    if q * p + cost(q * p) > cash + 1e-9:
                        q = int(max(cash - cost(q * p), 0) / p / 100) * 100
                    v = q * p
                    if v > 1 and v + cost(v) <= cash + 1e-9:
                        cash -= v + cost(v)
                        lots.setdefault(s, []).append((float(q), t))
                        n += 1
        want.append((cash + sum(held(s) * last[s] for s in lots), n))
    assert [n for _, n in got] == [n for _, n in want]
    assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(got, want, strict=True))
    assert sum(n for _, n in got) > 10


def test_backtest_within_reach_equals_the_whole(spark):
    """Many symbols of which few ever come near a purchase: the pruned fold gives the same, from far fewer rows."""
    r, rows = random.Random(12), []
    for s in range(60):
        price, drift = 5.0 + s, r.random() * (1.0 if s < 8 else 0.5)
        for t in range(40):
            close = round(price * (1 + r.uniform(-0.11, 0.11)), 2)
            if r.random() > 0.05:
                rows.append((s, date(2020, 1, 1) + timedelta(days=t), t, drift + 0.1 * r.random() if r.random() > 0.05 else None, price, close, 0.0 if r.random() < 0.1 else 100.0))
            price = close
    panel = spark.createDataFrame(rows, "symbol long, d date, day long, score double, price double, close double, volume double")
    strategies = {1: (2, 3), 2: (4, 7)}
    near = backtest.within_reach(backtest.prepared(panel, F.lit(0.10)), strategies)
    both = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("strategy"), F.lit(n).alias("top_k"), F.lit(i).alias("interval")) for k, (n, i) in strategies.items())))
    whole = backtest.prepared(panel.select("*", both.alias("x")).select(*panel.columns, "x.*"), F.lit(0.10), "strategy")
    got, want = (sorted(map(str, backtest.run_top_k(x).collect())) for x in (near, whole))
    assert got == want and len(got) == 80
    assert near.count() < 0.6 * whole.count()


def test_regimes_confirm(spark):
    path = [("rotation", 0.4), ("crowding", 0.5), ("crowding", 0.5), ("high_position_retreat", 0.1), ("range", 0.9), ("range", 0.9), ("range", 0.9), ("range", 0.2)]
    df = spark.createDataFrame([("m", date(2020, 1, 1 + k), r, p) for k, (r, p) in enumerate(path)], "market string, d date, regime string, p double")
    got = [r.confirmed for r in regimes.confirm(df).orderBy("d").collect()]
    assert got == ["rotation", "rotation", "crowding", "high_position_retreat", "high_position_retreat", "high_position_retreat", "range", "range"]
    assert regimes.confirm(df.limit(0)).count() == 0


# ---- portfolios


def test_trims_equal_a_greedy_loop(spark):
    r = random.Random(2)
    rows = [(1, k, r.choice([None, r.uniform(0, 100)]), 0, r.choice(["x", "y", None]), r.randint(0, 900)) for k in range(60)]
    df = spark.createDataFrame(rows, "portfolio long, symbol long, score double, held long, theme string, target long").withColumn("codes", F.array().cast("array<string>"))
    got = {x.symbol: x.target for x in portfolio.trim(df, ["portfolio", "theme"], F.lit(4000), F.col("theme").isNotNull(), "T").collect()}
    want = {x[1]: x[5] for x in rows}
    for g in ("x", "y"):
        own = sorted((x for x in rows if x[4] == g), key=lambda x: (-1 if x[2] is None else x[2], x[1]))
        total = sum(x[5] for x in own)
        for x in own:
            if total <= 4000:
                break
            cut = min(x[5], total - 4000)
            want[x[1]] -= cut
            total -= cut
    assert got == want


# ---- text


def fnv(text):
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) % 2**32
    return h


def test_hash_and_chunks(spark):
    for text in ("", "a", "中a", "hello world", "🙂x"):
        assert one(spark, retrieval.fnv1a(F.col("t")), t=text) == fnv(text)
    assert one(spark, F.size(retrieval.chunks(F.col("t"))), t="  ") == 0
    got = one(spark, retrieval.chunks(F.col("t"), 4), t=" ab  cd\nef ")
    assert [c.text for c in got] == ["ab c", "d ef"]
    # Words between white space; characters and their n-grams of the text without it, across words.
    for text in ("Ab c", "\u4e0a\u8bc1\u6307\u6570 \u4e0b\u8dcc", "a\u3000b\u00a0c\n", "x", "", " ", "\U0001f642y"):
        words, compact = text.lower().split(), "".join(text.lower().split())
        assert one(spark, retrieval.words(F.col("t")), t=text) == words
        assert one(spark, retrieval.characters(F.col("t")), t=text) == list(compact)
        for n in (2, 3):
            assert one(spark, retrieval.grams(retrieval.characters(F.col("t")), n), t=text) == [compact[i : i + n] for i in range(len(compact) - n + 1)]
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(compact) - n + 1):
                counts[fnv(compact[i : i + n]) % 384] = counts.get(fnv(compact[i : i + n]) % 384, 0) + 1
        norm = sum(v * v for v in counts.values()) ** 0.5
        assert {k: v for k, v in enumerate(retrieval.ngram_vector(text).tolist()) if v} == {k: round(v / norm, 8) for k, v in counts.items()}


def test_chinese_query_meets_its_document(spark):
    """Texts without spaces share characters, bigrams and trigrams, so the right one of two candidates comes first."""
    q = spark.createDataFrame([(1, "\u80a1\u7968\u4e0b\u8dcc\u98ce\u9669")], "query_id long, text string")
    d = spark.createDataFrame([(1, "\u4eca\u5929\u5929\u6c14\u5f88\u597d"), (2, "\u8fd9\u53ea\u80a1\u7968\u6709\u4e0b\u8dcc\u98ce\u9669"), (3, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, doc_id long")
    got = {r.doc_id: r for r in retrieval.candidate_scores(pairs, q, d).collect()}
    # Of 6 words and characters ... the query has 1 word, 6 characters, 5 bigrams and 4 trigrams.
    assert set(got) == {2} and got[2].overlap == (6 + 4 + 2) / 16 and got[2].bm25 > 0
    both = d.select(F.col("doc_id").alias("vec_id"), retrieval.embed("text").alias("embedding"))
    best = retrieval.dense_top_k(q.select("query_id", retrieval.embed("text").alias("embedding")), both, 1).first()
    assert best.vec_id == 2


def test_dense_top_k_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    vectors = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(99, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    ask = df.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, retrieval.dense_top_k(ask, df, 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 7 * 8 * 8)
    assert sorted(map(tuple, retrieval.dense_top_k(ask, df, 3).collect())) == whole
    assert len(whole) == 180 and all(r[1] == r[0] for r in whole if r[3] == 1)


# ---- streams and stores


def test_verdicts_equal_a_plain_loop(spark):
    r = random.Random(6)
    base = pd.Timestamp("2024-01-01")
    rows = [(k, r.randint(0, 150), 1, (base + pd.Timedelta(seconds=k + r.randint(-12, 3))).to_pydatetime(), 1.0) for k in range(300)]
    df = spark.createDataFrame(rows, "arrival long, event_id long, symbol long, event_time timestamp, last double").repartition(5)
    seen, top, want = set(), None, {}
    for a, i, _, t, _ in rows:
        if i in seen:
            want[a] = "DUPLICATE_EVENT"
            continue
        seen.add(i)
        want[a] = "LATE_EVENT" if top is not None and t < top - timedelta(seconds=5) else "ACCEPTED"
        top = t if top is None else max(top, t)
    assert {x.arrival: x.verdict for x in ticks.judged(df).collect()} == want


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("000123", 1.5, None), ("7", None, "a,b\"c")], "code string, x double, t string")
    stores.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(str, stores.read_csv(spark, str(tmp_path / "c"), "code string, x double, t string").collect())) == sorted(map(str, df.collect()))
    cal = spark.createDataFrame([(date(2020, 1, k),) for k in (1, 2, 3)], "d date")
    bars = spark.createDataFrame([(1, date(2020, 1, 1), 5.0), (1, date(2020, 1, 3), 6.0)], "symbol long, d date, close double")
    m = stores.columnar(bars, cal, "close")
    assert m.first()["values"] == [5.0, None, 6.0]
    assert sorted(map(tuple, stores.rows_of(m, cal, "close").collect())) == sorted(map(tuple, bars.collect()))


# ---- registry of indicators


def test_indicator_registry(spark):
    from marlstone.functions.indicators import INDICATORS, Indicator, Registry

    r = Registry()
    for v in ("1.9.0", "1.10.0"):
        r.add(Indicator("x", v, frozenset({"close", "volume"}), {"window": (2, 9)}, lambda window: F.lit(window)))
    assert r.get("x").version == "1.10.0" and r.get("x", "1.9.0").version == "1.9.0"
    assert r.missing(["x"], {"close"}) == {"x": {"volume"}}
    with pytest.raises(ValueError):
        r.add(r.get("x"))
    with pytest.raises(ValueError):
        r.get("x").build(window=1)
    with pytest.raises(ValueError):
        r.get("x").build(span=3)
    with pytest.raises(KeyError):
        r.get("y")
    values = [float(k) for k in range(1, 8)]
    got = [x.m for x in series(spark, values).select("d", INDICATORS.get("sma").build(window=3).alias("m")).orderBy("d").collect()]
    assert got == [None, None, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_uuid5(spark):
    import uuid

    from marlstone.plans.remaining import uuid5

    assert one(spark, uuid5(F.col("t")), t="chunk:1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:1"))


def test_last_variant_of_the_ladder_is_the_whole_chain(spark, sf):
    import marlstone.plans  # noqa: F401
    from marlstone.registry import REGISTRY

    rows = {r.variant: r for r in REGISTRY["ag_ablation"].build(spark, sf).collect()}
    whole = REGISTRY["ag_ir_run"].build(spark, sf).first()
    assert len(rows) == 8
    assert all(rows["with_conflict_resolution"][m] == whole[m] for m in ("recall", "precision5", "rr", "ndcg"))
