"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import cut


def known_labels(labels: DataFrame, label: str, fold_of: int | None = None) -> DataFrame:
    """(doc_id, y): one row per document with a label that isn't null; of several the least counts. With ``fold_of`` = m,
    documents whose crc32(doc_id as text) is divisible by m are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if fold_of:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % fold_of != 0)
    return known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, fold_of: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``rows_per_class`` labelled documents of each class.

    Documents are taken in the order of a hash of their id, so the sample does not depend on how tables are stored. Of
    rows that share an id the one of least text is taken; a null text counts as empty. Labels are those of ``known_labels``.
    """
    known = known_labels(labels, label, fold_of)
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    # At most 2 * rows_per_class ids: small enough to send to every task.
    chosen = F.broadcast(cut(picked[0].unionByName(picked[1])))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
