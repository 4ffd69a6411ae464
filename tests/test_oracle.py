"""Every query that has SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import marlstone.plans  # noqa: F401
from marlstone.registry import REGISTRY

WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    yield c
    c.close()


def plain(v):
    if v is None or v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def compare(spark, sf, con, name):
    df = REGISTRY[name].build(spark, sf)
    got = [tuple(map(plain, r)) for r in df.collect()]
    r = con.execute(REGISTRY[name].sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(plain(x[i]) for i in order) for x in r.fetchall()]
    key = lambda row: tuple((x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in row)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, sf, con, name):
    compare(spark, sf, con, name)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_query_without_sql_runs(spark, sf, name):
    assert REGISTRY[name].build(spark, sf).count() > 0
