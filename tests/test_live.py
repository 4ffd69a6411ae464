"""The live run against the replay: at any cut into batches, with batches run again, and with a batch that breaks off."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import ticks as T
from marlstone.streaming.live import FIELDS, Live

START = dt.datetime(2024, 1, 2, 9, 30)
SCHEMA = "arrival long, event_id long, symbol long, event_time timestamp, last double, volume double, amount double, sector string, at_limit_up boolean"


def ticks_of(n, seed, step=2.0):
    """Events of three symbols that arrive out of order, some late, some twice."""
    r, rows = random.Random(seed), []
    for k in range(n):
        behind = r.choice([0, 0, 1, 3, 8])
        if rows and r.random() < 0.1:
            rows.append((k, *rows[max(0, k - r.randrange(1, 15))][1:]))
            continue
        last, volume = round(r.uniform(5, 15), 2), float(r.randrange(0, 9))
        rows.append((k, 1000 + k, r.randrange(3), START + dt.timedelta(seconds=step * k - behind), last, volume, last * volume, r.choice(["a", None]), r.random() < 0.2))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cuts", [[40, 55], [1, 2, 119]])
def test_live_equals_replay_at_any_cut(spark, tmp_path, cuts):
    rows = ticks_of(120, 7)
    live = Live(str(tmp_path), kept=20)
    for batch, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = spark.createDataFrame(rows[a:z], SCHEMA)
        live.process(part, batch)
        if batch == 1:
            live.process(part, batch)  # again: replaces itself
        whole = T.judged(spark.createDataFrame(rows[:z], SCHEMA))
        accepted = whole.where("verdict = 'ACCEPTED'")
        assert rows_of(live.features(spark)) == rows_of(T.symbol_features(accepted, 20))
        assert rows_of(live.log(spark).select("arrival", "verdict")) == rows_of(whole.select("arrival", "verdict"))
    assert live.state(spark).groupBy("symbol").count().agg(F.max("count")).first()[0] <= 20


def test_broken_batch_is_run_again(spark, tmp_path, monkeypatch):
    """A stream that dies between the log and the state of a batch gives the same rows once when it is started again."""
    rows, source = ticks_of(60, 3), str(tmp_path / "source")
    live = Live(str(tmp_path / "live"))
    for a in range(0, 60, 20):
        spark.createDataFrame(rows[a : a + 20], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    write, broken = Live._write, []

    def breaking(self, df, name, batch):
        if name == "state" and batch == 1 and not broken:
            broken.append(batch)
            raise RuntimeError("killed")
        write(self, df, name, batch)

    monkeypatch.setattr(Live, "_write", breaking)
    with pytest.raises(Exception, match="killed"):
        live.start(stream).awaitTermination()
    live.start(stream).awaitTermination()
    accepted = T.judged(spark.createDataFrame(rows, SCHEMA)).where("verdict = 'ACCEPTED'")
    assert broken and rows_of(live.state(spark)) == rows_of(accepted.select(*FIELDS))
    assert live.log(spark).where("verdict = 'ACCEPTED'").count() == accepted.count()


def test_retention_and_whole_states(spark, tmp_path):
    rows = ticks_of(100, 5, step=20.0)
    live = Live(str(tmp_path), retention=600)
    for batch in range(10):
        live.process(spark.createDataFrame(rows[batch * 10 : batch * 10 + 10], SCHEMA), batch)
    latest = max(r[3] for r in rows)
    assert live.log(spark).count() == sum(r[3] >= latest - dt.timedelta(seconds=600) for r in rows)
    # Batches whose events were all too old when the last one began are gone from the disk too; of the state nothing before
    # the last whole one is left.
    then = max(r[3] for r in rows[:90]) - dt.timedelta(seconds=600)
    left = {b for b in range(10) if max(r[3] for r in rows[b * 10 : b * 10 + 10]) >= then}
    assert {r.batch for r in spark.read.parquet(f"{tmp_path}/log").select("batch").distinct().collect()} == left and len(left) < 7
    assert {r.batch for r in spark.read.parquet(f"{tmp_path}/state").select("batch").distinct().collect()} == {8, 9}
    accepted = T.judged(spark.createDataFrame(rows, SCHEMA)).where("verdict = 'ACCEPTED'")
    assert rows_of(live.features(spark)) == rows_of(T.symbol_features(accepted))
