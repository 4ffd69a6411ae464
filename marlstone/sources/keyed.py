"""A table by key: versions rewrite only the buckets that they touch, and point reads open only the buckets of their keys.

A row's bucket is a hash of its key. A version writes the merged rows of its buckets to new files, sorted by key and with
Bloom filters, then adds one small file that names the version of each bucket: readers see all of a version or nothing
of it. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``schema`` is a DDL string that holds ``key``; keys are not null. ``buckets`` bounds what the driver keeps."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.empty = spark.createDataFrame([], schema)
        self.schema = self.empty.schema

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, int]:
        """The version that holds each bucket: at most ``buckets`` entries."""
        try:
            made = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/commits")
            return {r.bucket: r.version for r in made.groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        except (AnalysisException, Py4JJavaError) as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.empty

    def rows(self) -> DataFrame:
        return self._read(self.versions())

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Rows replace those of their keys or are added. Of rows of one key the greatest counts, by the columns after the
        key in their order. A version that isn't newer than all before is one that was written already and changes nothing."""
        held = self.versions()
        if held and version <= max(held.values()):
            return
        rest = [c for c in self.schema.names if c != self.key]
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).where(F.col(self.key).isNotNull())
        touched = [r.bucket for r in new.select(self._bucket().alias("bucket")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = self._read({b: held[b] for b in touched if b in held})
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = both.groupBy(self.key).agg(F.max(F.struct("_new", *rest)).alias("_x")).select(self.key, *(F.col(f"_x.{c}").alias(c) for c in rest))
        merged = merged.select(*self.schema.names, self._bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", self.key)
        filters = {f"parquet.bloom.filter.enabled#{self.key}": "true"}
        merged.write.mode("overwrite").options(**filters).partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        made = self.spark.createDataFrame([(b, version) for b in touched], "bucket int, version long")
        made.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def get(self, keys: Iterable) -> DataFrame:
        """The rows of some keys. Only files of their buckets are opened; in these, row groups go by range and filter."""
        keys = list(keys)
        if not keys:
            return self.empty
        asked = self.spark.createDataFrame([(k,) for k in keys], [self.key]).select(self._bucket().alias("b")).distinct().collect()
        held = self.versions()
        return self._read({r.b: held[r.b] for r in asked if r.b in held}).where(F.col(self.key).isin(keys))
