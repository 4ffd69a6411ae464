"""From raw documents to packed training windows: five stages, each written as Parquet and read again by the next.

Every stage takes nulls in any column (a null text counts as empty), empty and very long texts, repeated rows, empty tables,
and further columns of any names. All but the last return the rows that stay, with all their columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import exact_dedup, packing, quality, simhash, toxicity
from marlstone.llm.session import new_table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the chain holds clean, each judged by its text alone; without labels of both classes all stay."""
    chain = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, chain)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more, each judged by its text alone; without labels all stay."""
    model = quality.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row of least id; rows equal in id and text stay together, and rows without an
    id stay only where no row with one has their text."""
    return exact_dedup.drop_copies(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 or more of their five-word shingles, the row of least id. Texts without words are
    one group; rows without an id stay."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; every row, repeated or without an id, is a document of its own, an empty one its closing id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("packing", pack),
]

#: Learned scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``; without documents, none. Labels of other documents don't count."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
