"""Near copies by an exact rule: two texts are near copies when their sets of five-word shingles have a Jaccard similarity of
0.8 or more.

Candidates come from three searches. The first takes the texts whose SimHashes a given search links, and pairs each with
the least of its group. The second does so for texts that share three least hashes. So a large group of copies falls into
few components at the cost of a few pairs a text. The third is a prefix filter and loses no pair: of two sets of that
similarity, each ordered alike, the first fifths share a shingle. Common shingles, as counted in a sample, come last in
that order; which ones are taken for common changes the work, not the result. Pairs of one component are left out of it.
Every candidate is compared by its whole sets before it counts as a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.session import cut, giving_back, hot_list, join_sized, map_texts, storing

#: Words of a shingle.
SHINGLE = 5
#: Bands of the first search and least hashes in each.
BANDS, IN_BAND = 4, 3
#: One document in SAMPLED is read for common shingles: those of COMMON documents among these, COMMON_ROWS at most.
SAMPLED, COMMON, COMMON_ROWS = 16, 3, 500_000
#: Pairs of a bucket that are listed at once.
CHUNK = 1 << 20
#: Counters of a sketch, and the count at which one is full.
COUNTERS, FULL = 256, 255
#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([xxhash.xxh64_intdigest(bytes([k]), 1) for k in range(BANDS * IN_BAND)], dtype=np.uint64)


class _Words(dict):
    """Hashes of words; the first 50,000 are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 5)
        if len(self) < 50_000:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``text``, lower-cased in A-Z and split at ASCII white space. A text of
    fewer words is one shingle; a text without words has none."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    own = np.array(list(map(words.__getitem__, found)), dtype=np.uint64)
    k = min(SHINGLE, own.size)
    out = np.full(own.size - k + 1, k, dtype=np.uint64)
    for at in range(k):
        out = _mixed(out * _MULTIPLIER + own[at : at + out.size])
    return np.unique(out)


def set_fingerprint(own: np.ndarray) -> int:
    """Signed SimHash of a set of 64-bit hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, own.size, 65_536):
        ones += np.unpackbits(own[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > own.size).tobytes(), "big", signed=True)


def sketch(own: np.ndarray) -> bytes:
    """Members of a set by the upper bits of their hash, as many counters of a byte."""
    return np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=COUNTERS), FULL).astype(np.uint8).tobytes()


def may_be_near(a: bytes, b: bytes, x: int, y: int) -> bool:
    """Whether sets of x and y members with these sketches can be near copies: they share no more than the lesser count of
    each counter. A counter that is full in both may hold any number."""
    least = np.minimum(np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8))
    return bool(least.max() == FULL) or near(int(least.sum(dtype=np.int64)), x, y)


def near(shared: int, x: int, y: int) -> bool:
    """Whether sets of x and y members that share so many have a similarity of 0.8 or more."""
    return 9 * shared >= 4 * (x + y)


def _common(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for b in batches:
            for at in range(0, len(b), 500):
                sets = [shingle_set(t, words) for t in b["text"].iloc[at : at + 500]]
                yield pd.DataFrame({"sh": np.concatenate(sets).view(np.int64)})

    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLED)) == 0)
    counts = map_texts(sample, run, "sh long", id_col, text_col).groupBy("sh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    with storing(docs.sparkSession):
        got = counts.orderBy(F.desc("n"), "sh").limit(COMMON_ROWS).select("sh").toPandas()
    return np.sort(got["sh"].to_numpy(dtype=np.int64).view(np.uint64))


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, size, sketch, fp, bands, prefix, rare): a digest and the size of each set, its sketch, its SimHash, its bands,
    its first shingles, and how many of these, which come before the others, aren't common."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, common = _Words(), sent.value
        for b in batches:
            keys, sizes, sketches, fps, bands, prefixes, rare = [], [], [], [], [], [], []
            for text in b["text"]:
                own = shingle_set(text, words)
                n = own.size
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(n)
                sketches.append(sketch(own))
                fps.append(set_fingerprint(own))
                if not n:
                    bands.append([])
                    prefixes.append([])
                    rare.append(0)
                    continue
                least = [_mixed(own ^ m).min() for m in _MASKS]
                bands.append([xxhash.xxh64_intdigest(np.array(least[k * IN_BAND : (k + 1) * IN_BAND]).tobytes(), k) - 2**63 for k in range(BANDS)])
                rare.append(n)
                if common.size:
                    last = common[np.minimum(np.searchsorted(common, own), common.size - 1)] == own
                    own = np.concatenate([own[~last], own[last]])
                    rare[-1] = n - int(last.sum())
                prefixes.append(own[: n - (4 * n + 4) // 5 + 1].view(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": keys, "size": sizes, "sketch": sketches, "fp": fps, "bands": bands, "prefix": prefixes, "rare": rare})

    return map_texts(docs, run, "doc_id long, key binary, size int, sketch binary, fp long, bands array<long>, prefix array<long>, rare int", id_col, text_col)


def _buckets(tagged: DataFrame) -> DataFrame:
    """(sh, part, node, size, pos): where the rows of ``tagged`` (doc_id, part, size, prefix, rare) are met by their first shingles.

    Near copies' sizes differ by a factor of 1.25 at most. So a row meets others under a common shingle only by size: in the
    step of its size's logarithm to a base a little above that, and in the next one, which two rows of neighbouring steps
    share. A rare shingle is a bucket by itself.
    """
    rows = tagged.select(F.col("doc_id").alias("node"), "part", "size", "rare", F.posexplode("prefix").alias("pos", "sh"))
    step = F.floor(F.log("size") / F.log(F.lit(1.26)))
    steps = F.when(F.col("pos") < F.col("rare"), F.array(F.lit(-1).cast("long"))).otherwise(F.array(step, step + 1))
    met = rows.withColumn("step", F.explode(steps))
    return met.select(F.when(F.col("step") < 0, F.col("sh")).otherwise(F.xxhash64("sh", "step")).alias("sh"), "part", "node", "size", "pos")


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b): pairs of different components in one bucket that may be near copies. A partition is sorted by bucket and
    component; a bucket's rows may lie in several batches."""
    names = ("sh", "part", "node", "size", "pos")
    held = {c: np.empty(0, dtype=np.int64) for c in names}

    def listed(rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        sh, part, node, size, left = rows["sh"], rows["part"], rows["node"], rows["size"], rows["size"] - rows["pos"]
        edge = np.r_[True, sh[1:] != sh[:-1]]
        run_edge = edge | np.r_[True, part[1:] != part[:-1]]
        ends = [np.r_[np.flatnonzero(e)[1:], sh.size] for e in (edge, run_edge)]
        stop, start = ends[0][np.cumsum(edge) - 1], ends[1][np.cumsum(run_edge) - 1]
        some = np.flatnonzero(stop > start)
        total = np.cumsum((stop - start)[some])
        at = 0
        while at < some.size:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
            own = some[at:to]
            n = (stop - start)[own]
            x = np.repeat(own, n)
            y = np.repeat(start[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            fits = 9 * np.minimum(left[x], left[y]) >= 4 * (size[x] + size[y])
            if fits.any():
                x, y = node[x[fits]], node[y[fits]]
                yield pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)}).drop_duplicates()
            at = to

    for batch in batches:
        rows = {c: np.concatenate([held[c], batch[c].to_numpy(dtype=np.int64)]) for c in names}
        if not rows["sh"].size:
            continue
        last = int(np.searchsorted(rows["sh"], rows["sh"][-1]))
        held = {c: x[last:] for c, x in rows.items()}
        if last:
            yield from listed({c: x[:last] for c, x in rows.items()})
    if held["sh"].size > 1:
        yield from listed(held)


def _with_both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of both ids' rows of ``rows`` (doc_id and ``columns``), named after the side. Only rows
    that some pair has are moved."""
    joined = pairs
    for side in ("a", "b"):
        sized = cut(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")))
        asked = F.broadcast(sized) if sized.count() <= BROADCAST_IDS else sized
        known = rows.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)).join(asked, side)
        joined = join_sized(joined, known, side, "n", F.xxhash64("a", "b"), "inner", hot_list(sized, side, "n")).drop("n")
    return joined


def near_pairs(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``pairs`` (a, b: ids) whose texts are near copies by their whole shingle sets. ``rows`` are the texts'
    sketches; pairs that cannot be near by these need no texts."""

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [may_be_near(a, b, x, y) for a, b, x, y in zip(batch["sketch_a"], batch["sketch_b"], batch["size_a"], batch["size_b"], strict=True)]
            yield batch.loc[np.array(fits, dtype=bool), ["a", "b"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            kept, text_held, own = [], None, None
            for s, t in zip(batch["text_a"], batch["text_b"], strict=True):
                if t is not text_held and t != text_held:
                    text_held, own = t, shingle_set(t, words)
                other = shingle_set(s, words)
                kept.append(near(np.intersect1d(own, other, assume_unique=True).size, own.size, other.size))
            yield batch.loc[np.array(kept, dtype=bool), ["a", "b"]]

    sketched = _with_both(cut(pairs.distinct()), rows, "sketch", "size").select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b")
    left = cut(sketched.mapInPandas(giving_back(possible), "a long, b long").distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut(_with_both(left, texts, "text").select("a", "b", "text_a", "text_b").mapInPandas(giving_back(run), "a long, b long").distinct())


def _fingerprint_stars(own: DataFrame, link_fingerprints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): each row of ``own`` (doc_id, fp) with the least id of the group that its fingerprint is linked to."""
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    member = components(link_fingerprints(nodes.select("fp"))).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = cut(nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("first").alias("b"), F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("rows")).where("rows > 1")
    of_node = cut(join_sized(rooted, least, "root", "nodes", F.xxhash64("fp"), "inner", hot_list(least, "root", "nodes")).select("fp", "b", "n"))
    stars = join_sized(own.select("doc_id", "fp"), of_node, "fp", "n", F.xxhash64("doc_id"), "inner", hot_list(of_node, "fp", "n"))
    return stars.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")


def redundant_ids(docs: DataFrame, link_fingerprints: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gone): ids of documents that a chain of near copies joins to one of smaller id, so one document of each group is left.

    A null text counts as empty; texts without words are copies of each other. Rows without an id are never named. An empty
    table gives an empty result. ``link_fingerprints`` gives links (a, b) of a table of SimHashes (fp).
    """
    docs = docs.where(F.col(id_col).isNotNull())
    rows = cut(_sketches(docs, id_col, text_col))
    nodes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    # Rows of a set that has been met with a smaller id need no search.
    met = rows.join(nodes.where("n > 1").select("key", "node"), "key", "left").where("doc_id > node").select(F.col("doc_id").alias("gone"))
    met = cut(met.distinct())
    own = rows.where("size > 0").join(met, F.col("doc_id") == F.col("gone"), "left_anti")

    banded = own.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    first = cut(banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = join_sized(banded, first, "band", "n", F.xxhash64("node"), "inner", hot_list(first, "band", "n")).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    sure = near_pairs(_fingerprint_stars(own, link_fingerprints).unionByName(stars), docs, own.select("doc_id", "sketch", "size"), id_col, text_col)
    parts = components(sure).select(F.col("a").alias("doc_id"), F.col("b").alias("part"))

    tagged = own.join(parts, "doc_id", "left").select("doc_id", F.coalesce("part", "doc_id").alias("part"), "size", "prefix", "rare")
    dealt = _buckets(tagged).repartition("sh").sortWithinPartitions("sh", "part")
    further = near_pairs(dealt.mapInPandas(giving_back(_pairs), "a long, b long"), docs, own.select("doc_id", "sketch", "size"), id_col, text_col)
    return components(sure.unionByName(further)).select(F.col("a").alias("gone")).unionByName(met).distinct()
