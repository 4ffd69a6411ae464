"""Ranks and running values over whole tables, and folds over the ordered rows of a key, without one task for all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """``df`` stored in the folder of ``spark.checkpoint.dir`` (a temporary one where it is unset), so that what is derived
    from it twice sees the same rows in the same partitions and a lost executor costs nothing."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return df.checkpoint()


def _in_ranges(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    return materialised(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def _before(parts: DataFrame, value: Column, over_parts: Callable) -> DataFrame:
    """One row per partition: ``over_parts`` of the values of all partitions before it."""
    own = parts.groupBy("_p").agg(value.alias("_v"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(own.select("_p", over_parts("_v").over(w).alias("_carried")))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 1 over the whole table in that total order: rows are numbered within range partitions and on from the
    sizes of the partitions before."""
    parts = _in_ranges(df, order)
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    carried = _before(parts, F.count(F.lit(1)), F.sum)
    out = parts.withColumn("_k", own).join(carried, "_p")
    return out.withColumn("rank", (F.col("_k") + F.coalesce("_carried", F.lit(0))).cast("long")).drop("_p", "_k", "_carried")


def running_max_before(df: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """The largest ``value`` of all rows before each in that total order; null for the first."""
    parts = _in_ranges(df, order)
    own = F.max(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("_k", own).join(_before(parts, F.max(value), F.max), "_p")
    return out.withColumn(name, F.greatest("_k", "_carried")).drop("_p", "_k", "_carried")


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[object], object], step: Callable[[object, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """A sequential fold over the rows of each key: ``start(key)`` makes a state; ``step(state, rows)`` gets all rows of the
    next ``order[0]`` value, in order, changes the state and gives output rows.

    Rows of a key are dealt to one task and streamed in order: a task holds the rows of one step at a time, never a key's.
    """
    dealt = df.repartition(key).sortWithinPartitions(key, *order)
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, state = None, None, None
        out: list[tuple] = []

        def close(rows: pd.DataFrame) -> None:
            nonlocal now, state
            k = rows[key].iloc[0]
            if state is None or k != now:
                now, state = k, start(k)
            out.extend(step(state, rows))

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            changed = ((rows[key] != rows[key].shift()) | (rows[order[0]] != rows[order[0]].shift())).to_numpy().nonzero()[0].tolist()
            for a, b in zip(changed, changed[1:], strict=False):
                close(rows.iloc[a:b])
            held = rows.iloc[changed[-1] :]
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held is not None and len(held):
            close(held)
        if out:
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(run, schema)
