"""The near-copy stage against all pairs of five-word shingle sets."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import shingles, simhash

DOCS = "doc_id long, text string"


def words_of(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def brute_gone(rows):
    rows = sorted(rows)
    sets, holders = [], defaultdict(list)
    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
        for x in sets[k]:
            holders[x].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in holders[x] if j < k).items():
            if 5 * o >= 4 * len(s | sets[j]):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[k][0] for k in range(len(rows)) if find(k) != k}


def planted():
    """Copies with more and more words changed at once (similarity on both sides of 0.8), reordered texts of equal words,
    common passages, a large group, short and empty texts."""
    r = random.Random(11)
    passage, rows = words_of(r, 60), []
    for k in range(60):
        w = words_of(r, 100)
        for edits in range(0, 12):
            rows.append(w[:10] + words_of(r, edits) + w[10 + edits :])
        rows += [w[50:] + w[:50], w[::-1], passage + w[:8 + k % 9]]
    base = words_of(r, 200)
    for _ in range(300):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(200)] = words_of(r, 1)[0]
        rows.append(w)
    rows += [[], [], ["one"], ["ONE"], ["one", "two"], ["a", "b", "c", "d", "e"]]
    r.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("common", [3, 10**9])
def test_exactly_the_rule(spark, monkeypatch, common):
    monkeypatch.setattr(shingles, "COMMON", common)
    monkeypatch.setattr(shingles, "CHUNK", 1000)
    rows = planted()
    kept = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    want = brute_gone(rows)
    assert 300 < len(want) < len(rows) - 100
    assert {k for k, _ in rows} - kept == want


def test_equal_words_in_another_order_stay(spark):
    w = words_of(random.Random(2), 80)
    rows = [(1, " ".join(w)), (2, " ".join(sorted(w))), (3, " ".join(w[40:] + w[:40]))]
    kept = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {1, 2, 3} - brute_gone(rows) and 2 in kept


def test_all_pairs_without_the_first_search():
    """The prefix filter alone lists every pair of the rule."""
    known, rows = shingles._Words(), []
    for k, text in planted()[:400]:
        own = shingles.shingle_set(text, known)
        n = own.size
        rows += [(int(x), k, k, n, i) for i, x in enumerate(own[: n - (4 * n + 4) // 5 + 1].view(np.int64))]
    import pandas as pd

    table = pd.DataFrame(rows, columns=["sh", "part", "node", "size", "pos"]).sort_values(["sh", "part"])
    got = {(a, b) for f in shingles._pairs(iter([table[:700], table[700:]])) for a, b in f.itertuples(index=False)}
    texts = dict(planted()[:400])
    sets = {k: set(shingles.shingle_set(t, known).tolist()) for k, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a > b and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want and want <= got
