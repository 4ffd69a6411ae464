"""Ranked lexical search over a tiered index.

The index is partitioned by documents: a row holds the postings of some thousand documents. Of each term the first tier has
the postings of highest impact, the second the rest, whose largest impact is the term's residual. A search reads the first
tier only, which bounds every document's score from both sides; the twentieth largest lower bound of an item is its
threshold. An item is proved by the first tier where no term of it has a residual anywhere. All others fall through: every
document whose upper bound reaches the threshold gets its exact score from the second tier, and no other can be among the
best.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.session import map_texts, stored

#: ASCII but letters and digits separates terms; A-Z are lower-cased; bytes of other characters belong to terms.
_SEPARATED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Postings of a term in a block up to which all are in the first tier; beyond, the share that is.
SHORT, SHARE = 64, 1 / 8
#: Bytes of item texts that are searched for at once.
ITEM_BYTES = 4 << 20
RAW_SCHEMA = "docs binary, absent binary, lengths binary, with_terms long, total long, terms binary, counts binary, posted binary, tf binary"
TIER_SCHEMA = "docs binary, absent binary, terms binary, start1 binary, posted1 binary, impact1 binary, residual binary, start2 binary, posted2 binary, impact2 binary"
HIT_SCHEMA = "item int, doc_id long, score long, open boolean"


def split(text: str) -> list[bytes]:
    """The terms of a whole text, repeats included."""
    return text.encode().translate(_SEPARATED).split()


def _invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block of postings for each batch: terms in order, and of each its documents in order with their frequencies."""
    for b in batches:
        if not len(b):
            continue
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        lengths = np.zeros(len(b), dtype=np.int64)
        keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, text in enumerate(b["text"]):
            own = Counter(split(text))
            lengths[i] = own.total()
            keys.append(np.fromiter(map(vocabulary.__getitem__, own), dtype=np.int64, count=len(own)) * len(b) + i)
            counts.append(np.fromiter(own.values(), dtype=np.int64, count=len(own)))
        names = np.array(sorted(vocabulary), dtype=object)
        place = np.empty(len(names), dtype=np.int64)
        place[[vocabulary[t] for t in names]] = np.arange(len(names))
        key, tf = np.concatenate(keys), np.concatenate(counts)
        key = place[key // len(b)] * len(b) + key % len(b)
        order = np.argsort(key)
        key, tf = key[order], tf[order]
        absent = b["doc_id"].isna().to_numpy()
        yield pd.DataFrame(
            {
                "docs": [b["doc_id"].fillna(0).to_numpy(np.int64).tobytes()], "absent": [np.packbits(absent).tobytes()], "lengths": [lengths.tobytes()], "with_terms": [int((lengths > 0).sum())],
                "total": [int(lengths.sum())], "terms": [b" ".join(names)], "counts": [np.bincount(key // len(b), minlength=len(names)).astype("<i4").tobytes()], "posted": [(key % len(b)).astype("<i4").tobytes()],
                "tf": [tf.astype("<i4").tobytes()],
            }
        )


@dataclass(frozen=True)
class Index:
    """``raw``: the blocks with frequencies; ``tiers``: the same postings by tier, with impacts. ``n``: documents with a term;
    ``length``: terms of all documents."""

    raw: DataFrame
    tiers: DataFrame
    n: int
    length: int


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype("<i4")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows and whole texts, written in the shared folder without a shuffle: a batch of documents is a block."""
    raw = stored(map_texts(docs, _invert, RAW_SCHEMA, id_col, text_col), "postings")
    sums = raw.agg(F.coalesce(F.sum("with_terms"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("length")).first()
    n, length = sums["n"], sums["length"]

    def tiers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, dtype=np.int64)
                # Longer than 2**63 / 25 / n terms no text is, but a product in Python can't overflow anyway.
                m = np.array([75 + 25 * int(x) * n // length for x in lengths] if length else [], dtype=np.int64)
                counts, posted, tf = (np.frombuffer(x, dtype="<i4").astype(np.int64) for x in (r.counts, r.posted, r.tf))
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[posted]) if len(tf) else tf
                start = _starts(counts)
                first, residual = np.ones(len(posted), dtype=bool), np.zeros(len(counts), dtype=np.int64)
                for t in np.nonzero(counts > SHORT)[0]:
                    own, some = impact[start[t] : start[t + 1]], max(SHORT, int(counts[t] * SHARE))
                    order = np.argpartition(-own, some)
                    first[start[t] + order[some:]] = False
                    residual[t] = own[order[some]]
                term = np.repeat(np.arange(len(counts)), counts)
                out = [r.docs, r.absent, r.terms]
                for keep in (first, ~first):
                    out += [_starts(np.bincount(term[keep], minlength=len(counts))).tobytes(), posted[keep].astype("<i4").tobytes(), impact[keep].astype("<i4").tobytes()]
                    if keep is first:
                        out.append(residual.astype("<i4").tobytes())
                yield pd.DataFrame([out], columns=[c.split()[0] for c in TIER_SCHEMA.split(", ")])

    both = raw.select("docs", "absent", "lengths", "terms", "counts", "posted", "tf").mapInPandas(tiers, TIER_SCHEMA)
    return Index(raw, stored(both, "tiers"), n, length)


def frequencies(index: Index, asked: set[bytes]) -> dict[bytes, int]:
    """In how many documents each term of ``asked``, those of a bounded block of items, occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for b in batches:
            for terms, counts in zip(b["terms"], b["counts"], strict=True):
                for t, n in zip(terms.split(), np.frombuffer(counts, dtype="<i4").tolist(), strict=True):
                    if t in asked:
                        found[t] += n
        yield pd.DataFrame({"term": list(found.keys()), "df": list(found.values())})

    rows = index.raw.select("terms", "counts").mapInPandas(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


class _Block:
    """One row of the tiers, opened."""

    def __init__(self, row: tuple, tiers: int) -> None:
        ints = lambda x: np.frombuffer(x, dtype="<i4")
        self.docs = np.frombuffer(row.docs, dtype=np.int64)
        self.absent = np.unpackbits(np.frombuffer(row.absent, dtype=np.uint8), count=len(self.docs)).astype(bool)
        self.place = {t: i for i, t in enumerate(row.terms.split())}
        self.residual = ints(row.residual)
        self.lists = [tuple(ints(getattr(row, f"{c}{k}")) for c in ("start", "posted", "impact")) for k in range(1, tiers + 1)]

    def posted(self, term: int, tier: int) -> tuple[np.ndarray, np.ndarray]:
        start, posted, impact = self.lists[tier]
        a, z = start[term], start[term + 1]
        return posted[a:z], impact[a:z].astype(np.int64)

    def bounds(self, weights: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """By the first tier: lower and upper bounds of all documents' scores; the terms of the item that are here."""
        low, high = np.zeros(len(self.docs), dtype=np.int64), np.zeros(len(self.docs), dtype=np.int64)
        here = [(self.place[t], w) for t, w in weights if t in self.place]
        for t, w in here:
            at, impact = self.posted(t, 0)
            low[at] += w * impact
            rest = int(self.residual[t])
            high[at] -= w * rest
            high += w * rest
        return low, low + high, here

    def complete(self, low: np.ndarray, rows: np.ndarray, here: list[tuple[int, int]]) -> np.ndarray:
        """The exact scores of ``rows``, by their postings in the second tier."""
        score = low[rows]
        for t, w in here:
            at, impact = self.posted(t, 1)
            if len(at):
                place = np.minimum(np.searchsorted(at, rows), len(at) - 1)
                score += np.where(at[place] == rows, w * impact[place], 0)
        return score


class _Best:
    """The ``k`` best rows seen of each item: highest scores first, then least ids, rows without an id last."""

    def __init__(self, k: int) -> None:
        self.k, self.kept, self.open = k, {}, set()

    def add(self, item: int, score: np.ndarray, docs: np.ndarray, absent: np.ndarray) -> None:
        if item in self.kept:
            score, docs, absent = (np.concatenate(x) for x in zip(self.kept[item], (score, docs, absent), strict=True))
        order = np.lexsort((docs, absent, -score))[: self.k]
        self.kept[item] = score[order], docs[order], absent[order]

    def rows(self) -> Iterator[pd.DataFrame]:
        for item, (score, docs, absent) in self.kept.items():
            ids = pd.array(docs, dtype="Int64")
            ids[absent] = pd.NA
            yield pd.DataFrame({"item": item, "doc_id": ids, "score": score, "open": item in self.open})


def _search(index: Index, items: list[list[tuple[bytes, int]]], k: int, spark: SparkSession) -> DataFrame:
    """HIT_SCHEMA of ``items``, each a list of terms with their whole weights."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for b in batches:
            for row in b.itertuples(index=False):
                block = _Block(row, 1)
                for item, weights in enumerate(items):
                    low, _, here = block.bounds(weights)
                    some = np.nonzero(low)[0]
                    if any(block.residual[t] for t, _ in here):
                        best.open.add(item)
                    if len(some) > k:
                        some = some[low[some] >= -np.partition(-low[some], k - 1)[k - 1]]
                    best.add(item, low[some], block.docs[some], block.absent[some])
        yield from best.rows()

    columns = [c.split()[0] for c in TIER_SCHEMA.split(", ")]
    found = stored(index.tiers.select(*columns[:7]).mapInPandas(first, HIT_SCHEMA), "first-tier")
    w = Window.partitionBy("item").orderBy(F.desc("score"))
    unproved = found.groupBy("item").agg(F.max("open").alias("open")).where("open").select("item")  # no more rows than items in the block
    least = found.withColumn("at", F.row_number().over(w)).where(F.col("at") == k).select("item", "score")
    threshold = {r["item"]: r["score"] or 1 for r in unproved.join(least, "item", "left").collect()}

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for b in batches:
            for row in b.itertuples(index=False):
                block = _Block(row, 2)
                for item, least in threshold.items():
                    low, high, here = block.bounds(items[item])
                    rows = np.nonzero(high >= least)[0]
                    score = block.complete(low, rows, here)
                    rows, score = rows[score > 0], score[score > 0]
                    best.add(item, score, block.docs[rows], block.absent[rows])
        yield from best.rows()

    proved = found.join(F.broadcast(unproved), "item", "left_anti")
    return proved.unionByName(index.tiers.mapInPandas(second, HIT_SCHEMA)) if threshold else proved


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` highest-scoring documents with a score above 0 of each row of ``items``.

    Equal scores go by doc_id; documents without an id come last among equals; rows that share an id are documents of their
    own, and rows of ``items`` that share one are ranked each. Null and empty texts have no terms: nothing is found by or for
    them. Other columns aren't read. Items are a stated set of queries, taken in blocks of about ITEM_BYTES: a block's terms
    and weights go to the tasks, and a task sends back ``k`` rows an item.
    """
    spark = items.sparkSession
    asked = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks, out = max(1, -(-size // ITEM_BYTES)), None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()  # ITEM_BYTES or so
        times = [Counter(split(r["text"])) for r in block]
        df = frequencies(index, set().union(*times)) if times else {}
        weight = {t: math.floor(1000 * math.log((2 * index.n + 2) / (2 * f + 1))) for t, f in df.items()}
        weighted = [[(t, weight[t] * n) for t, n in own.items() if weight.get(t)] for own in times]
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long")
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = _search(index, weighted, k, spark).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        own = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    return out
