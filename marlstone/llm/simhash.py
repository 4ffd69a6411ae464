"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit in one of two blocks of 31. On
each block the words of the Hamming code of length 31 serve as anchors: every block lies within one bit of exactly one
(covering radius 1). A fingerprint is replicated to every anchor within that radius plus the block's threshold of one
bit: at most 16 per block. If two fingerprints are within a bit on a block, the anchor nearest to one gets both, and
they are compared there on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import shingles
from marlstone.llm.components import components
from marlstone.llm.session import cut, fresh, giving_back, join_sized, map_texts

#: Bits that linked fingerprints may differ in, at most.
THRESHOLD = 3
BLOCK = 31
SEED = 42
#: Replicas of an anchor from which on it is split, as counted over one fingerprint in SAMPLED; anchors of that kind that
#: are broadcast at most.
HOT_ROWS, SAMPLED, BROADCAST_ROWS = 50_000, 16, 200_000


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned SimHash of the shingles of ``text``, lower-cased in A-Z and split at ASCII white space; 0 without words."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), dtype=np.uint64, count=n
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    return map_texts(docs, run, "doc_id long, fp long", id_col, text_col)


def _syndrome(block: Column) -> Column:
    """The exclusive or of the block's set positions; position p (1 to 31) is bit p - 1. Anchors are the blocks of syndrome 0."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, BLOCK + 1) if p >> k & 1)
        out = out + F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(mask))) % 2, k)
    return out


def _anchors(block: Column, syndrome: Column) -> Column:
    """The anchors within two bits of a block: flipping position p leads to one when p is the syndrome, and flipping p and
    q does when p xor q is."""

    def bit(p: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (p - 1).cast("int"))

    home = F.when(syndrome == 0, block).otherwise(block.bitwiseXOR(bit(F.greatest(syndrome, F.lit(1)))))
    pairs = F.filter(
        F.sequence(F.lit(1), F.lit(BLOCK)), lambda p: (syndrome != 0) & (p != syndrome) & (p < p.bitwiseXOR(syndrome))
    )
    further = F.transform(pairs, lambda p: block.bitwiseXOR(bit(p)).bitwiseXOR(bit(p.bitwiseXOR(syndrome))))
    return F.concat(F.array(home), further)


def replicas(distinct: DataFrame) -> DataFrame:
    """(anchor, block, fp) for every anchor that a fingerprint of ``distinct`` (fp) is replicated to, on both blocks."""
    mask = F.lit((1 << BLOCK) - 1)
    parts = distinct.select(
        "fp", F.posexplode(F.array(*(F.shiftrightunsigned("fp", BLOCK * k).bitwiseAND(mask) for k in range(2)))).alias("block", "part")
    )
    near = parts.withColumn("syndrome", _syndrome(F.col("part"))).select("fp", "block", F.explode(_anchors(F.col("part"), F.col("syndrome"))).alias("anchor"))
    return near.select(F.col("anchor").bitwiseOR(F.shiftleft(F.col("block").cast("long"), BLOCK)).alias("anchor"), "block", "fp")


def _rest_masks(block: int) -> list[int]:
    """The bits outside a block in four parts: fingerprints that differ in three bits at most agree on one of them."""
    rest = [b for b in range(64) if not BLOCK * block <= b < BLOCK * (block + 1)]
    masks = [sum(1 << b for b in rest[k::4]) for k in range(4)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def dealt_replicas(distinct: DataFrame) -> DataFrame:
    """(key, fp): replicas by anchor. Anchors that by a sample have HOT_ROWS replicas or more are split by what their
    fingerprints have outside the block; which ones are split changes the work, not the links."""
    rows = replicas(distinct)
    sample = replicas(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0))
    hot = cut(sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLED >= HOT_ROWS).select("anchor", F.lit(True).alias("hot")))
    count = hot.count()
    if not count:
        return rows.select(F.col("anchor").alias("key"), "fp")
    tagged = rows.join(F.broadcast(hot) if count <= BROADCAST_ROWS else hot, "anchor", "left")
    split = F.array(*(
        F.xxhash64("anchor", F.lit(k), F.when(F.col("block") == 0, F.col("fp").bitwiseAND(F.lit(a))).otherwise(F.col("fp").bitwiseAND(F.lit(b))))
        for k, (a, b) in enumerate(zip(_rest_masks(0), _rest_masks(1), strict=True))
    ))
    return tagged.select(F.explode(F.when(F.col("hot"), split).otherwise(F.array("anchor"))).alias("key"), "fp")


def group_links(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links (fingerprint, least of its component) among ``fps`` (unsigned, distinct), each component once.

    Each member visits those not yet reached, so a dense group costs little more than a pass over it and never lists its
    pairs.
    """
    links, left = [], np.sort(fps)
    while left.size > 1:
        seed, frontier, left = left[0], [left[0]], left[1:]
        while frontier and left.size:
            near = np.bitwise_count(left ^ frontier.pop()) <= threshold
            if near.any():
                reached = left[near]
                left = left[~near]
                frontier.extend(reached)
                links.extend((int(x), int(seed)) for x in reached)
    return links


def _compare(batches: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    """Links of a partition that is sorted by key; a key's rows may lie in several batches."""
    held_k, held_f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

    def links(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame | None:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, keys.size])
        two = starts[sizes == 2]
        x, y = fps[two], fps[two + 1]
        near = np.bitwise_count(x ^ y) <= threshold
        found = set(zip(np.maximum(x, y)[near].tolist(), np.minimum(x, y)[near].tolist(), strict=True))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found.update(group_links(fps[s : s + n], threshold))
        if not found:
            return None
        rows = np.array(sorted(found), dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1]})

    for batch in batches:
        keys = np.concatenate([held_k, batch["key"].to_numpy(dtype=np.int64)])
        fps = np.concatenate([held_f, batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)])
        if not keys.size:
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        held_k, held_f = keys[last:], fps[last:]
        if last and (out := links(keys[:last], fps[:last])) is not None:
            yield out
    if held_k.size > 1 and (out := links(held_k, held_f)) is not None:
        yield out


def near_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that join the fingerprints of ``distinct`` (fp) within ``threshold`` (at most 3) bits of others into
    their components; every link is itself such a chain."""
    if threshold > THRESHOLD:
        raise ValueError("the anchors cover three bits")
    dealt = dealt_replicas(distinct).repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(giving_back(lambda it: _compare(it, threshold)), "a long, b long").distinct()


def near_groups(
    docs: DataFrame, shingle: int = 3, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Fingerprints link when at most ``threshold`` bits differ; equal ones are one node, however many rows have them. A null
    text counts as empty; empty texts have fingerprint 0, which links like any other. A component of null ids only has a
    null component_id. Equal rows keep their rows; an empty table gives an empty result; other columns are not read.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    # Nodes are ordered as signed numbers here and below; any order serves.
    member = components(near_links(nodes.select("fp"), threshold))
    rooted = cut(
        nodes.join(member.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    of_node = join_sized(rooted, least, "root", "nodes", F.xxhash64("fp")).select("fp", "component_id", "n")
    out = join_sized(rows, cut(of_node), "fp", "n", F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies the one of least id.

    Near copies share 0.8 or more of their five-word shingles. Candidates are first the texts whose SimHashes of these
    shingles are linked by the anchors; every candidate is compared by its whole sets, and a prefix filter finds the pairs
    whose fingerprints are further apart (``shingles``). A null text counts as empty; texts without words are copies of each
    other. Ids are taken to be unique; rows that share the least id all stay, and so do rows without an id. An empty table
    gives an empty result; other columns are kept, whatever these are called.
    """
    name = fresh(docs, "_gone")
    gone = shingles.redundant_ids(docs, near_links, id_col, text_col).withColumnRenamed("gone", name)
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
