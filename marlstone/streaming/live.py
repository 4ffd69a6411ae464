"""Live ticks: micro-batches that are judged as one log, a retained log of accepted events, and a state per symbol that batch
queries read. What a batch leaves behind is written under its id, so a batch that is run again replaces its own rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.streaming import ticks as T

C = F.col

#: Seconds that the log reaches back from the latest event time; batches after which the state is written whole.
RETENTION, WHOLE_EVERY = 3_600, 8
LOG_SCHEMA = "arrival long, event_id long, symbol long, event_time timestamp, last double, volume double, amount double, sector string, at_limit_up boolean, verdict string, batch long"
STATE_SCHEMA = "arrival long, event_id long, symbol long, event_time timestamp, last double, volume double, amount double, sector string, at_limit_up boolean, batch long"
FIELDS = ["arrival", "event_id", "symbol", "event_time", "last", "volume", "amount", "sector", "at_limit_up"]


@dataclass(frozen=True)
class Live:
    """A live run under ``root``, a shared folder: ``root/log`` has every judged event, ``root/state`` the last ``kept``
    accepted events (null: all) of each symbol, both by batch; ``root/checkpoint`` is Spark's own."""

    root: str
    lateness: int = T.LATENESS
    kept: int | None = T.KEPT
    retention: int = RETENTION

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Process what is there of ``stream`` (FIELDS, in micro-batches of rising arrival), from where the last run of this
        root stopped, and end."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self.process)
        return writer.trigger(availableNow=True).start()

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch. Only rows of earlier batches are read, which are complete when this one begins: so running it again
        after a failure anywhere in it writes the same."""
        spark = rows.sparkSession
        log = self._read(spark, "log", LOG_SCHEMA).where(C("batch") < batch)
        latest = log.where("verdict <> 'DUPLICATE_EVENT'").agg(F.max("event_time")).first()[0]
        if self._trim(spark, log, latest):
            log = self._read(spark, "log", LOG_SCHEMA).where(C("batch") < batch)
        verdicts = T.judged(T.valid(rows).select(*FIELDS), self.lateness, log, latest).select(*FIELDS, "verdict")
        self._write(verdicts, "log", batch)
        new = self._read(spark, "log", LOG_SCHEMA).where((C("batch") == batch) & (C("verdict") == "ACCEPTED")).select(*FIELDS)
        whole = batch % WHOLE_EVERY == 0
        old = self._states(spark, batch - 1)
        if not whole:  # only symbols of this batch are written anew
            old = old.join(new.select("symbol").distinct(), "symbol", "left_semi")
        back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("arrival")))
        both = old.select(*FIELDS).unionByName(new)
        if self.kept is not None:
            both = both.withColumn("back", back).where(C("back") <= self.kept).drop("back")
        self._write(both, "state", batch)
        if batch % WHOLE_EVERY == 1:  # the batch before is complete, so nobody reads what is older
            self._drop(spark, "state", lambda b: b < batch - 1)

    def log(self, spark: SparkSession) -> DataFrame:
        """Judged events not older than ``retention`` behind the latest."""
        log = self._read(spark, "log", LOG_SCHEMA)
        latest = log.agg(F.max("event_time").alias("latest"))  # one row
        return log.join(F.broadcast(latest)).where(C("event_time") >= C("latest") - F.expr(f"interval {self.retention} seconds")).drop("latest")

    def state(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The last ``kept`` accepted events of each symbol (FIELDS), after ``batch`` or now."""
        return self._states(spark, batch).select(*FIELDS)

    def features(self, spark: SparkSession) -> DataFrame:
        """``symbol_features`` of the state: those of the whole log up to the last batch."""
        return T.symbol_features(self.state(spark), self.kept)

    # ---- storage

    def _states(self, spark: SparkSession, batch: int | None) -> DataFrame:
        s = self._read(spark, "state", STATE_SCHEMA)
        s = s if batch is None else s.where(C("batch") <= batch)
        newest = s.groupBy("symbol").agg(F.max("batch").alias("batch"))
        return s.join(newest, ["symbol", "batch"], "left_semi")

    def _path(self, spark: SparkSession, name: str):  # noqa: ANN202
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        p, fs = self._path(spark, name)
        if not fs.exists(p):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _trim(self, spark: SparkSession, log: DataFrame, latest: datetime | None) -> bool:
        """Batches go whose events are all older than the retention. Their ids are forgotten: should one come again, it is
        late. True if any went."""
        if latest is None:
            return False
        newest = log.groupBy("batch").agg(F.max("event_time").alias("t")).where(C("t") < F.lit(latest - timedelta(seconds=self.retention)))
        old = {r["batch"] for r in newest.collect()}  # a row a batch of the retained log
        if old:
            self._drop(spark, "log", old.__contains__)
        return bool(old)

    def _drop(self, spark: SparkSession, name: str, gone) -> None:  # noqa: ANN001
        p, fs = self._path(spark, name)
        for f in fs.listStatus(p):
            batch = f.getPath().getName().partition("batch=")[2]
            if batch and gone(int(batch)):
                fs.delete(f.getPath(), True)
