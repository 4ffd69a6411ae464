"""URL filter, centroid clustering and ranked search against plain loops, on tables with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import centroids, ranked_search, url_filter
from marlstone.llm.queries import RULES
from marlstone.llm.url_filter import Rule

# ---- URL filter

URLS = [
    ("http://A.Example.COM/en/x?y", "a.example.com", "/en/x"), ("https://x.com", "x.com", ""), ("//x.com/a", "", ""), (None, "", ""), ("", "", ""), ("a://b://c/d#e", "b:", "//c/d"),
    ("http://h?q=/a", "h", ""), ("http://h#f://g/", "h", ""), ("x\ny://ho\nst/p\nq?r", "ho\nst", "/p\nq"), ("http://É.net/es/", "É.net", "/es/"), ("http://" + "w" * 50_000 + "/" + "p" * 50_000, "w" * 50_000, "/" + "p" * 50_000),
]


def test_host_and_path(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URLS], "url string")
    host, path = url_filter.parts(F.col("url"))
    assert [tuple(r) for r in df.select("url", host, path).collect()] == URLS


def test_longest_rule_wins(spark):
    cases = [
        ("example.com", "/en/", "example.com/en/", "block"), ("www.example.com", "/en/a", "www.example.com/en/", "allow"), ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("m.example.com", "/en/1", "example.com/en/", "block"),
        ("badexample.com", "/en/", "com/", "allow"), ("example.com", "", None, None), ("com", "/", "com/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("x.net", "/de/", None, None), ("xnet", "/es/", None, None), ("", "", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "host string, path string")
    name, verdict = url_filter.longest_rule(F.col("host"), F.col("path"), RULES)
    assert [tuple(r) for r in df.select("host", "path", name, verdict).collect()] == cases


def plain_bounds(hosts):
    """The bounds of {host: (n, k)} by loops."""

    def up(children, parent):
        out = {}
        for c, (n, k) in children.items():
            a, b = out.get(parent(c), (0, 0))
            out[parent(c)] = a + n, b + k
        return out

    def weight(children, parents, parent):
        own = {c: x for c, x in children.items() if x[0]}
        many, groups, total = len(own), sum(1 for x in parents.values() if x[0]), sum(n for n, _ in own.values())
        rho = None
        if many > groups and total > many:
            mean = lambda c: parents[parent(c)][1] / parents[parent(c)][0]
            msb = sum(n * (k / n - mean(c)) ** 2 for c, (n, k) in own.items()) / (many - groups)
            msw = sum(n * (k / n) * (1 - k / n) for n, k in own.values()) / (total - many)
            size = (total - sum(n * n / parents[parent(c)][0] for c, (n, _) in own.items())) / (many - groups)
            if msb + (size - 1) * msw > 0:
                rho = (msb - msw) / (msb + (size - 1) * msw)
        rho = min(max(url_filter.LEAST_RHO if rho is None else rho, url_filter.LEAST_RHO), url_filter.MOST_RHO)
        return (1 - rho) / rho

    domain = lambda h: ".".join(h.split(".")[-3:] if ".".join(h.split(".")[-2:]) in url_filter.TWO_LABEL_SUFFIXES else h.split(".")[-2:])
    suffix = lambda h: ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in url_filter.TWO_LABEL_SUFFIXES else h.split(".")[-1]
    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    whole = up(suffixes, lambda s: "")
    mean = {"": (whole[""][1] + 0.5) / (whole[""][0] + 1)}
    for children, parents, parent in ((suffixes, whole, lambda s: ""), (domains, suffixes, suffix), (hosts, domains, domain)):
        s = weight(children, parents, parent)
        mean = {c: (s * mean[parent(c)] + k) / (s + n) for c, (n, k) in children.items()}
    return {h: max(0.0, m - url_filter.SIGMAS * math.sqrt(m * (1 - m) / (s + hosts[h][0] + 1))) for h, m in mean.items()}


@pytest.fixture
def pages(spark):
    r = random.Random(3)
    hosts = [f"{a}.{b}.{c}" for a in "wxy" for b in ("good", "bad", "mixed") for c in ("org", "net", "co.uk")] + ["lone", "", "co.uk"]
    rows, known = [], []
    for i in range(1500):
        h = "w.bad.org" if i % 3 == 0 else r.choice(hosts)
        rows.append((i, f"http://{h}/p{i}"))
        if i % 2:
            known.append((i, int(r.random() < (0.97 if "bad" in h else 0.5 if "mixed" in h else 0.02))))
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(known, "page_id long, bad int"), rows, dict(known)


def test_reputation_equals_plain_loops(pages):
    df, known, rows, bad = pages
    got = {r.page_id: r for r in url_filter.judge(df, known, [Rule("net", "/", "block")]).collect()}
    hosts = {}
    for i, url in rows:
        h = url.split("/")[2]
        n, k = hosts.get(h, (0, 0))
        hosts[h] = n + (i in bad), k + bad.get(i, 0)
    want = plain_bounds(hosts)
    assert len(got) == len(rows)
    for i, url in rows:
        h = url.split("/")[2]
        assert got[i].bad_bound == pytest.approx(want[h], abs=2e-6)
        assert got[i].verdict == ("block" if h.endswith(".net") or want[h] >= url_filter.LIMIT else "allow")
    blocked = {r.host for r in got.values() if r.verdict == "block" and r.rule is None}
    assert blocked and all("bad" in h for h in blocked)
    # A host without outcomes of its own falls under its domain.
    more = url_filter.judge(df.unionByName(df.sparkSession.createDataFrame([(9999, "http://new.bad.org/")], df.schema)), known, [])
    assert more.where("page_id = 9999").first().bad_bound > 0.3


def test_url_filter_awkward(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "bound", "rows", "n", "k", "_hot", "_salt")})
    got = url_filter.judge(df, none, RULES)
    assert sorted(map(tuple, got.select("page_id", "host", "verdict").collect()), key=str) == sorted([(1, "a.org", "allow")] * 2 + [(None, "a.org", "allow"), (2, "", "allow"), (3, "", "allow")], key=str)
    assert url_filter.judge(df.limit(0), none, RULES).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, None), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.outcomes(labels).collect())) == [(1, 1), (3, 1), (4, 0)]


# ---- centroids


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    best = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [[v for _, v in kept if best(v) == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c[j] for j, g in enumerate(own)]
    out = [(i, best(v), far(v, c[best(v)])) for i, v in kept]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def test_clusters_equal_plain_loops(spark):
    r = random.Random(11)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(150)] + [(200 + i, [0.25] * 16) for i in range(60)]
    rows += [(300, None), (301, [0.1] * 15), (302, [None] + [0.1] * 15), (303, [float("nan")] + [0.1] * 15), (304, [float("inf")] + [0.1] * 15), (305, []), (306, [0.0] * 16), (5, rows[5][1]), (None, [-1.5, 900.25] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "code", "cluster", "distance", "inertia", "v")})
    got = centroids.cluster(df.repartition(5), k=7, rounds=3, components=16)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, 7, 3)
    few = centroids.cluster(df.where("vec_id in (306, 1)"), k=7, rounds=2, components=16)
    assert sorted((x.vec_id, x.distance) for x in few.collect()) == [(1, 0), (306, 0)]
    assert centroids.cluster(df.limit(0), k=7, components=16).count() == 0


def test_screening_is_exact_and_rules_out():
    r = np.random.default_rng(4)
    middles = r.integers(-90, 90, (40, 64))
    x = (middles[r.integers(0, 40, 3000)] + r.integers(-12, 13, (3000, 64))).astype(np.int64)
    x[:5] = 0
    code, step, rest = centroids.compress(x)
    wide = np.empty(x.shape, dtype=np.int64)
    wide[:, ::2], wide[:, 1::2] = code >> 4, code & 15
    cluster, distance, taken = centroids.nearest(x, wide - 8, step, rest.astype(float), (x * x).sum(axis=1), middles)
    every = ((x[:, None, :] - middles) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert taken < 0.2 * every.size  # of clustered vectors most centroids are ruled out


# ---- ranked search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: WORD.findall((t or "").translate(low))
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 75 + 25 * c.total() * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [2, 64])
def test_search_equals_plain_loop(spark, awkward, clashing, monkeypatch, short):
    monkeypatch.setattr(ranked_search, "SHORT", short)
    r = random.Random(short)
    vocabulary = ["the", "of", "Größe", "中文", "naïve", "x1", *(f"w{i}" for i in range(40))]
    docs = [(i, " ".join(r.choices(vocabulary, [40, 20] + [1] * 44, k=r.randrange(0, 60)))) for i in range(300)]
    docs += [(i + 1000, "the of the w1-W1_w2") for i in range(50)] + [(x.doc_id, x.text) for x in awkward.collect()]
    items = [(0, "the of w3 w3 naïve"), (1, None), (2, ""), (3, "absent"), (4, "W1 w2 the"), (4, "中文,größe"), (None, "fox dog x"), (5, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("docs", "terms", "score", "item", "rank", "item_id")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    index = ranked_search.build(d.repartition(4))
    got = sorted(map(tuple, ranked_search.search(index, q, 5).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_search(docs, items, 5)
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 100)
    assert sorted(map(tuple, ranked_search.search(index, q, 5).select("item_id", "rank", "doc_id", "score").collect()), key=str) == got


def test_search_of_nothing(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = ranked_search.build(empty)
    assert ranked_search.search(index, some).count() == 0 and ranked_search.search(index, none).count() == 0


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_centroids", "op13_ranked_search"])
def test_queries_equal_sql(spark, sf, name):
    from pathlib import Path

    import duckdb

    from marlstone.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, sf)
    r = con.execute(ORACLE_SQL[name])
    order = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=str)
