"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(links: DataFrame, rows: int) -> DataFrame:
    """(a, m): the least neighbour of each node. Stored, so that the join with it has a shuffle of its own on both sides and
    adaptive execution can split the partition of a node with very many links."""
    return stored(links.groupBy("a").agg(F.min("b").alias("m")), "least", rows)


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    near = _both_ways(links)
    least = _least(near, 2 * rows).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, rows)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(a, b): every node of ``links`` but the least of its component, with that least node.

    ``links`` has columns a, b (bigint); direction and repeats don't matter. Each round is stored in the shared folder.
    Rounds grow with the logarithm of the node count; more than ``limit`` of them stop the job.
    """

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = digest(now)
    if not before[0]:
        return now
    for _ in range(limit):
        rows = before[0]
        large = stored(_large_star(now, rows), "links", 2 * rows)
        now = stored(_small_star(large, 2 * rows), "links", 4 * rows)
        after = digest(now)
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")
