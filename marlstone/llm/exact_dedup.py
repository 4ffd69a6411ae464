"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

1. Memtables: each task of the scan holds the digests of its rows and flushes them, sorted, as one run: a Parquet file
   with its own minima, maxima and Bloom filter on the digest.
2. Compaction merges the runs into a level: one row per digest with the surviving identifier and the number of rows, cut
   into files by ranges of the digest, sorted, each with its Bloom filter. So a look-up (``lookup``) opens the files whose
   range and filter may hold the digest.
3. A filter over the digests that were hit more than once is tested by every row; only rows that may be hits go on with
   their text. It has BITS_PER_HIT bits a digest; when that is more than can be broadcast, rows are joined to the hits.
4. Hits are verified byte by byte: they are grouped by digest and text together, and equality of the group's key
   compares the bytes. Copies collapse in each task before the shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import cut, fresh, join_sized, new_table_path

#: A filter's bits are kept in rows of 4,096 bytes each, made by Spark's bitmap functions.
ROW_BITS = 32_768
#: Bits of a filter for each key in it, and bytes of a filter that is broadcast at most.
BITS_PER_HIT, BROADCAST_BYTES = 16, 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: a multiple of a row's, at least one row."""
    return max(1, -(-keys * BITS_PER_HIT // ROW_BITS)) * ROW_BITS


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, key_col: str, count: int, found: bool = True) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be one of the ``count`` values of ``keys[key_col]``, none of which is lost; or the
    others (``found`` False). A null key may always be."""
    bits = filter_bits(count)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    part, bitmap = fresh(rows, "_part"), fresh(rows, "_bitmap")
    marks = keys.where(F.col(key_col).isNotNull()).select(slot(F.col(key_col)).alias("slot"))
    marks = marks.select((F.col("slot") / ROW_BITS).cast("int").alias(part), (F.col("slot") % ROW_BITS).alias("bit"))
    filters = marks.groupBy(part).agg(F.bitmap_construct_agg("bit").alias(bitmap))
    tagged = rows.withColumn(part, F.when(key.isNotNull(), (slot(key) / ROW_BITS).cast("int")))
    joined = tagged.join(F.broadcast(filters), part, "left")  # ``bits`` / 8 bytes at most
    hit = key.isNull() | F.coalesce(_bit_is_set(F.col(bitmap), slot(key) % ROW_BITS), F.lit(False))
    return joined.where(hit if found else ~hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def flush_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sorted runs of (digest, id), written in the shared folder: one per task, without a shuffle."""
    spark = docs.sparkSession
    path = new_table_path(spark, "runs")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))
    (
        rows.sortWithinPartitions("digest")
        .write.option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.max.bytes", str(1 << 20))
        .parquet(path)
    )
    return spark.read.schema("doc_id long, digest binary").parquet(path)


def compact(runs: DataFrame, keep: str) -> DataFrame:
    """Runs merged to one row per digest, as the next level: (digest, keep_id, group_size), sorted, in files of disjoint
    ranges of the digest. Rows of one digest are merged in each task before any is moved."""
    spark = runs.sparkSession
    path = new_table_path(spark, "level")
    best = {"smallest": F.min, "largest": F.max}[keep]
    merged = cut(runs.groupBy("digest").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    merged.repartitionByRange("digest").sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
    return spark.read.schema("digest binary, keep_id long, group_size long").parquet(path)


def lookup(level: DataFrame, texts: list[str | None]) -> DataFrame:
    """The rows of ``level`` for some texts. The condition reaches the scan, which skips files and row groups by their ranges
    and Bloom filters. Null texts count as empty."""
    digests = {hashlib.sha256((t or "").translate(str.maketrans(UPPER, LOWER)).encode()).digest() for t in texts}
    return level.where(F.col("digest").isin(*[F.lit(d) for d in sorted(digests)]) if digests else F.lit(False))


def verified_hits(docs: DataFrame, level: DataFrame, keep: str, id_col: str, text_col: str) -> DataFrame:
    """(digest, keep_id, group_size) of texts that occur more than once, grouped by their bytes."""
    hits = level.where("group_size > 1")
    count = hits.count()
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body")).select(
        "doc_id", "body", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")
    )
    if filter_bits(count) <= 8 * BROADCAST_BYTES:
        maybe = maybe_in(rows, F.col("digest"), hits, "digest", count)
    else:
        sized = hits.select("digest", "group_size")
        maybe = join_sized(rows, sized, "digest", "group_size", F.xxhash64("doc_id"), "inner").select("doc_id", "body", "digest")
    groups = maybe.groupBy("digest", "body").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select("digest", "keep_id", "group_size", F.lit(1).alias("texts"))
    # Two texts of one SHA-256 must not be merged: stop instead.
    return groups.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.sum("texts").alias("texts")
    ).select(
        "digest",
        "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest")).cast("long"))
        .otherwise(F.col("group_size"))
        .alias("group_size"),
    )


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the ``keep`` ("smallest" or
    "largest") id stays. A null text equals the empty text. A null id is never the one that stays, unless all of its
    group are null: then keep_id is null and all its rows stay. Rows that share the surviving id all stay. An empty
    table gives an empty result; other columns are not read.
    """
    runs = flush_runs(docs, id_col, text_col)
    level = compact(runs, keep)
    hits = verified_hits(docs, level, keep, id_col, text_col)
    path = new_table_path(docs.sparkSession, "hits")
    hits.write.parquet(path)
    hits = docs.sparkSession.read.schema("digest binary, keep_id long, group_size long").parquet(path)
    out = join_sized(runs, hits, "digest", "group_size", F.xxhash64("doc_id"))
    in_group = F.col("group_size").isNotNull()
    return out.select(
        "doc_id",
        F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("doc_id") == F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")), F.lit(True) & F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    A row goes when its id and text are those of a dropped row of ``exact_groups``; so rows that are equal in both go or
    stay together, and rows that only share an id are judged apart.
    """
    dropped = exact_groups(docs, keep, id_col, text_col).where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    i, t = fresh(docs, "_gone_id"), fresh(docs, "_gone_text")
    gone = cut(dropped.toDF(i, t))
    count = gone.count()
    unsure, sure = docs, None
    if filter_bits(count) <= 8 * BROADCAST_BYTES:
        # Most rows can't be dropped ones by their id; they don't move.
        unsure, sure = (maybe_in(docs, F.col(id_col), gone, i, count, found) for found in (True, False))
    same = unsure[id_col].eqNullSafe(gone[i]) & (F.sha2(normalised(unsure[text_col]).cast("binary"), 256) == gone[t])
    left = unsure.join(gone, same, "left_anti")
    return left if sure is None else sure.unionByName(left)
