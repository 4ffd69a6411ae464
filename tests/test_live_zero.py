"""Prices of zero in a tick log: ratios over them are those of doubles, as in SQL, and a live run keeps them."""

import datetime as dt
import math

import duckdb
import pytest

from marlstone.registry import REGISTRY
from tests.test_oracle import compare

START = dt.datetime(2024, 1, 2, 9, 30)


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Four symbols with events of zero price: an earlier one, all of them, the last one, and a single event."""
    prices = {1: [0.0] * 3 + [5.0, 6.0], 2: [0.0] * 5, 3: [4.0, 5.0, 6.0, 7.0, 0.0], 4: [0.0]}
    rows = [(s, k, p) for s, own in prices.items() for k, p in enumerate(own)]
    rows.sort(key=lambda r: (r[1], r[0]))
    ids = [(100 + i, START + dt.timedelta(seconds=400 * k + s), s, "error" if s == 4 else "view", p, "{}") for i, (s, k, p) in enumerate(rows)]
    d = str(tmp_path_factory.mktemp("zeros"))
    spark.createDataFrame(ids, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(k, 1.5) for k in range(6)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{d}/customer.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    yield d, con
    con.close()


@pytest.mark.parametrize("name", ["st_symbol_features", "st_aggregate", "st_overlay", "sink_state_kv", "st_batch_loop", "sink_redis_stream"])
def test_zero_prices_equal_sql(spark, zeros, name):
    d, con = zeros
    compare(spark, d, con, name)


def test_zero_divisors_are_infinite(spark, zeros):
    got = {r.symbol: r for r in REGISTRY["st_symbol_features"].build(spark, zeros[0]).collect()}
    assert got[1].return_5m == 0.2 and math.isinf(got[1].return_15m) and math.isnan(got[2].return_5m) and got[3].return_1m == -1
