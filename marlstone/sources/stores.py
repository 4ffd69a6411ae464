"""Typed readers and idempotent writers: CSV and JSON files, snapshots by key, columnar bar batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed columns: codes stay texts, with their leading zeros; a field that doesn't fit its type stops the read."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "\\N").option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_version(df: DataFrame, path: str, version: int) -> None:
    """Write rows as a version of a snapshot table; the same version written twice replaces itself."""
    df.withColumn("_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version").parquet(path)


def current(spark: SparkSession, path: str, key: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """The newest version of each key. With ``made`` its rows are the key and these columns, made of the stored ones as they
    are read, so that wide columns aren't shuffled."""
    t = spark.read.parquet(path)
    if made is not None:
        t = t.select(*key, "_version", *(c.alias(name) for name, c in made.items()))
    rest = [c for c in t.columns if c not in key and c != "_version"]
    return t.groupBy(*key).agg(F.max_by(F.struct(*rest), "_version").alias("_x")).select(*key, "_x.*")


def columnar(bars: DataFrame, calendar: DataFrame, field: str) -> DataFrame:
    """One row per symbol: its values of ``field`` on every day of ``calendar`` (d), in order, null where it has none."""
    days = calendar.agg(F.array_sort(F.collect_set("d")).alias("days"))  # one row of trading days
    own = bars.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("d", field))).alias("m"))  # a symbol's days
    return own.join(F.broadcast(days)).select("symbol", F.transform("days", lambda d: F.try_element_at(C("m"), d)).alias("values"))


def rows_of(matrix: DataFrame, calendar: DataFrame, field: str) -> DataFrame:
    """The long form again: (symbol, d, field) of what is not null."""
    days = calendar.agg(F.array_sort(F.collect_set("d")).alias("days"))
    z = matrix.join(F.broadcast(days)).select("symbol", F.explode(F.arrays_zip(C("days"), C("values"))).alias("x"))
    return z.select("symbol", C("x.days").alias("d"), C("x.values").alias(field)).where(C(field).isNotNull())


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary"), 256)
