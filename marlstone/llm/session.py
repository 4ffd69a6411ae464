"""Shared folders, bounded-skew joins and row helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has at least this share of all rows; so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 500
#: Parts into which the rows of a hot key are dealt.
SALTS = 64


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Settings while a table is stored: Arrow batches for Python of 8 MB at most, and shuffle files that go once it is there.
STORING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """The session under STORING; its own settings hold again afterwards. For results that are computed within the block: what
    is only declared in it runs under the session's own."""
    own = {k: spark.conf.get(k, None) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, so a lost executor costs no lineage."""
    shared_root(df.sparkSession)
    with storing(df.sparkSession):
        return df.checkpoint(eager=True)


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"


#: Rows of a file that ``stored`` writes when the number of rows is known.
FILE_ROWS = 200_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again. Unlike ``cut`` it carries no constraints over, which
    would pile up over many rounds, and its size is known to the planner. With ``rows``, an upper bound of its rows, it is
    written in files of FILE_ROWS, not one for each of many nearly empty partitions."""
    path = new_table_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with storing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def giving_back(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn``, after which a worker's free memory goes back to the system: workers outlive their tasks, and what each keeps of
    the last one is lost to the executor's other workers."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return run


def map_texts(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Run ``fn`` over (id, text) batches of ``df`` without a shuffle; a null text arrives as the empty string.

    A batch is bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB by default), so long texts come a
    few at a time.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(giving_back(fn), schema)


#: Texts that ``scored`` gives to its function at once.
SCORED_AT_ONCE = 500


def scored(fn: Callable[[list[str]], np.ndarray], text: Column) -> Column:
    """``fn``'s number of each text; a null text counts as empty. ``fn`` gets SCORED_AT_ONCE texts at most, so what it makes of
    them doesn't grow with a batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [fn(texts.iloc[at : at + SCORED_AT_ONCE].tolist()) for at in range(0, len(texts), SCORED_AT_ONCE)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    @F.pandas_udf("double")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from giving_back(run)(batches)

    return number(F.coalesce(text, F.lit("")))


def stored_where(docs: DataFrame, condition: Column, name: str) -> DataFrame:
    """The rows of ``docs`` that meet ``condition``, with all their columns, stored: under STORING a batch that goes to Python
    has 8 MB of texts at most. Parquet takes no columns without a type; these are put back as nulls."""
    void = {c for c, kind in docs.dtypes if kind == "void"}
    rows = stored(docs.where(condition).drop(*void), name)
    return rows.select(*[F.lit(None).alias(c) if c in void else rows[f"`{c.replace('`', '``')}`"] for c in docs.columns]) if void else rows


def hot_keys(sized: DataFrame, key: str, size: str) -> DataFrame:
    """Keys of ``sized`` with at least HOT_SHARE of the rows counted in ``size``: never more than 1/HOT_SHARE of them."""
    total = sized.agg(F.sum(size).alias("_total"))
    return (
        sized.select(key, size)
        .crossJoin(F.broadcast(total))  # one row
        .where((F.col(size) >= F.greatest(F.lit(2000.0), F.col("_total") * F.lit(HOT_SHARE))))
        .select(key)
    )


def hot_list(sized: DataFrame, key: str, size: str) -> list:
    """The keys of ``hot_keys``, found by a job of their own: at most 1/HOT_SHARE of them."""
    most, total = sized.agg(F.max(size), F.sum(size)).first()
    least = max(2000.0, (total or 0) * HOT_SHARE)
    if most is None or most < least:
        return []
    return [r[0] for r in sized.where((F.col(size) >= least) & F.col(key).isNotNull()).select(key).collect()]


def join_sized(
    rows: DataFrame, sized: DataFrame, key: str, size: str, spread: Column, how: str = "left", hot_ones: list | None = None
) -> DataFrame:
    """Join ``rows`` to one row per key of ``sized`` on ``key``; rows of hot keys are dealt over SALTS partitions.

    ``sized[size]`` is the number of rows of that key. ``spread`` is any well-spread column of ``rows`` (such as a hash
    of the row's id). The hot keys, at most 1/HOT_SHARE of them, are broadcast; their row of ``sized`` is copied per salt.
    With ``hot_ones``, the keys of ``hot_list``, the plan doesn't search for them: it is a single join, where the search
    repeats the steps of ``sized`` five times.
    """
    if hot_ones is not None:
        if not hot_ones:
            return rows.join(sized, key, how)
        is_hot, salts = F.col(key).isin(hot_ones), F.sequence(F.lit(0), F.lit(SALTS - 1))
        left = rows.withColumn("_salt", F.when(is_hot, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        right = sized.withColumn("_salt", F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0)))))
        return left.join(right, [key, "_salt"], how).drop("_salt")
    hot = F.broadcast(hot_keys(sized, key, size).withColumn("_hot", F.lit(True)))
    left = rows.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    right = (
        sized.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [key, "_salt"], how).drop("_salt")
