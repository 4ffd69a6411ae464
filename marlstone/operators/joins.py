"""Point-in-time joins: latest row per key, interval membership, and as-of by a running maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is greatest by ``order``, which should be total; partial maxima go before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def in_force(left: DataFrame, intervals: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to", how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the intervals of their key that hold at ``at``; both ends count and an open end is null."""
    r = intervals.withColumnRenamed(key, "_key")
    held = (F.col(key) == F.col("_key")) & (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(end) >= F.col(at)))
    return left.join(r, held, how).drop("_key")


def intervals_of(observed: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Intervals (key, value, valid_from, valid_to) from observations: each holds until the day before the next change."""
    w = Window.partitionBy(key).orderBy(at)
    changed = observed.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return changed.select(key, value, F.col(at).alias("valid_from"), F.date_sub(F.lead(at).over(w), 1).alias("valid_to"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order: list[str], payload: list[str]) -> DataFrame:
    """``left`` with the payload of the row of ``right`` that is greatest by ``order`` among those of its key with
    right_time <= left_time; null where there is none.

    Both sides go through one shuffle by key and one running maximum, so no pairs are made.
    """
    found = F.struct(*order, *(p for p in payload if p not in order))
    marks = right.select(F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_asks"), found.alias("_found"), F.lit(None).alias("_row"))
    asks = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_asks"), F.lit(None).alias("_found"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy("_key").orderBy("_time", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("_best", F.max("_found").over(w))
    return both.where("_asks = 1").select("_row.*", *(F.col(f"_best.{p}").alias(p) for p in payload))


def total_of(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row of totals, for broadcasting against ``df``."""
    return F.broadcast(df.agg(*aggregates))
