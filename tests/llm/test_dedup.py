"""Exact and near deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import components, exact_dedup, queries, simhash

DOCS = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[lower(t)].append(i)
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_equal_brute_force(awkward, keep):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    own, want = groups(rows), []
    for i, t in rows:
        ids = own[lower(t)]
        known = [x for x in ids if x is not None]
        best = None if not known else min(known) if keep == "smallest" else max(known)
        want.append((str(i), str(best), len(ids), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(awkward, keep).collect()]
    assert sorted(got) == sorted(want)


def test_drop_copies_keeps_columns_and_apart_what_only_shares_an_id(spark, clashing, empty):
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "5", "None", "7", "8", "9", "10"])
    same_id = spark.createDataFrame([(1, "a"), (2, "A"), (2, "other"), (None, "b"), (3, "b")], DOCS)
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(same_id).collect()) == [("1", "a"), ("2", "other"), ("3", "b")]
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def test_exact_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.OP6_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op6_exact_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[list(want.columns)].astype(str).equals(want.astype(str))


def test_hot_group(spark):
    """A group with most rows is dealt over salts and loses none."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("same").alias("text"))
    r = exact_dedup.exact_groups(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).orderBy("group_size").collect()
    assert [tuple(x) for x in r] == [(1, 3000, 3000), (6000, 6000, 1)]


def test_level_is_searched_by_range_and_filter(spark):
    """Files of the level have disjoint ranges of digests and Bloom filters; a look-up's condition reaches the scan and gives
    what brute force does."""
    import pyarrow.parquet as pq

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), (F.col("id") % 4000).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would make one file
    level = exact_dedup.compact(exact_dedup.flush_runs(docs.repartition(5), "doc_id", "text"), "smallest")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = []
    for f in level.inputFiles():
        group = pq.ParquetFile(f.removeprefix("file:")).metadata.row_group(0)
        ranges.append((group.column(0).statistics.min, group.column(0).statistics.max))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    asked = ["TEXT 7", "text 3999", "no such text", None]
    found = exact_dedup.lookup(level, asked)
    assert sorted((r.keep_id, r.group_size) for r in found.collect()) == [(7, 2), (3999, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(digest" in plan
    assert exact_dedup.lookup(level, []).count() == 0


def test_filter_loses_no_key(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"))
    keys = spark.range(0, 20_000, 7).select(F.col("id").alias("key"))
    n = keys.count()
    got = {r.k for r in exact_dedup.maybe_in(rows, F.col("k"), keys, "key", n).collect()}
    rest = {r.k for r in exact_dedup.maybe_in(rows, F.col("k"), keys, "key", n, found=False).collect()}
    assert set(range(0, 20_000, 7)) <= got and got | rest == set(range(20_000)) and not got & rest and len(got) < 2 * n


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_copies_go_with_and_without_filters(spark, awkward, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", most)
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_copies(awkward).collect()) == sorted(["1", "3", "5", "None", "7", "8", "9", "10"])


def slow_fingerprint(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0d]+", lower(text).encode())]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprint_of_noise():
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice("aAbB \t\n\x0b\x1f é") for _ in range(r.randint(0, 40)))
        assert simhash.fingerprint(text) == slow_fingerprint(text), repr(text)


def test_near_groups_equal_brute_force(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(awkward.select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    rows = docs.collect()
    fps = np.array([slow_fingerprint(r.text) for r in rows], dtype=np.uint64)
    want = brute_components([r.doc_id for r in rows], fps)
    expected = sorted((str(r.doc_id), f"{int(f):016x}", str(c)) for r, f, c in zip(rows, fps, want, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(docs).collect()) == expected


@pytest.mark.parametrize("hot", [1, 50_000])
def test_anchors_lose_no_link(spark, monkeypatch, hot):
    """Random fingerprints with planted neighbours at 0 to 4 bits, a chain and a dense group."""
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)  # 1: every anchor that the sample meets is split
    monkeypatch.setattr(simhash, "SAMPLED", 1 if hot == 1 else 16)
    r = random.Random(7)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in fps[:200]:
        g = f
        for b in r.sample(range(64), r.randint(0, 4)):
            g ^= 1 << b
        fps.append(g)
    chain = r.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 0b111 << b
        fps.append(chain)
    fps += [fps[0] ^ 1 << b for b in range(64)] + [0, 1, 2**63, 2**64 - 1]
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    root = {int(x): int(x) for x in signed}
    root |= {x.a: x.b for x in components.components(simhash.near_links(df)).collect()}
    want = brute_components([int(x) for x in signed], fps)
    assert [root[int(x)] for x in signed] == want


def test_near_copies_go(spark, empty, clashing):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    base = [[r.choice(words) for _ in range(300)] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, w in enumerate(base[:20]):
        copy = list(w)
        copy[r.randrange(300)] = "other"
        rows.append((100 + k, " ".join(copy)))
    kept = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert {k for k in range(40)} <= kept and len(kept) <= 42
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.near_groups(empty).count() == 0
    out = simhash.drop_near_copies(clashing)
    assert out.columns == clashing.columns
    # Equal rows and rows without an id stay; copies of a smaller id go.
    assert sorted(str(x.doc_id) for x in out.collect()) == sorted(["1", "3", "5", "None", "None", "8", "9", "10"])


def test_components_of_a_path(spark):
    n = 400
    links = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components.components(links).collect()
    assert len(got) == n - 1 and all(x.b == 0 for x in got)
    assert components.components(links.limit(0)).count() == 0
