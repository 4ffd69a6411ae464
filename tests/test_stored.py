"""Statements in two times, the table by key and golden cases against plain Python."""

import json
import random
from datetime import date, timedelta

import pytest

from marlstone.sources import golden
from marlstone.sources import statements as S
from marlstone.sources.keyed import KeyedTable

PERIODS = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2021, 3, 31)]


@pytest.fixture(scope="module")
def reports(spark):
    r = random.Random(3)
    rows = []
    for symbol in range(6):
        for p in PERIODS:
            days = sorted(r.sample(range(10, 500), r.randint(0, 3)))
            rows += [(symbol, p, p + timedelta(days=k), float(r.randint(1, 99))) for k in days]
    return rows, spark.createDataFrame(rows, "symbol long, period_end date, announced date, revenue double")


def test_revisions_are_known_until_the_next(reports):
    rows, df = reports
    got = {(x.symbol, x.period_end, x.announced): (x.revision, x.superseded) for x in S.scan(df).collect()}
    for symbol, period, announced, _ in rows:
        days = sorted(a for s, p, a, _ in rows if (s, p) == (symbol, period))
        k = days.index(announced)
        assert got[symbol, period, announced] == (k + 1, days[k + 1] if k + 1 < len(days) else None)


def test_scans_by_both_times(reports):
    rows, df = reports
    low, high = "2020-06-01", "2021-01-31"
    inside = lambda d: date.fromisoformat(low) <= d <= date.fromisoformat(high)
    assert S.scan(df, low, high).count() == sum(inside(a) for _, _, a, _ in rows)
    assert S.scan(df, low, high, "report_time").count() == sum(inside(p) for _, p, _, _ in rows)
    whole = {(x.symbol, x.period_end, x.announced): x.revision for x in S.scan(df).collect()}
    assert all(whole[x.symbol, x.period_end, x.announced] == x.revision for x in S.scan(df, low, high).collect())
    with pytest.raises(ValueError):
        S.scan(df, by="import_time")


def test_what_was_known_on_a_day(spark, reports):
    rows, df = reports
    days = [(s, date(2020, 4, 1) + timedelta(days=k)) for s in range(7) for k in range(0, 900, 13)]
    asked = spark.createDataFrame(days, "symbol long, d date")
    for x in S.known(asked, df, "d", ["revenue"]).collect():
        seen = [(p, a, v) for s, p, a, v in rows if s == x.symbol and a <= x.d]
        assert (x.period_end, x.announced, x.revenue) == max(seen, default=(None, None, None))
    every = spark.createDataFrame([(s, d, p) for s, d in days for p in PERIODS], "symbol long, d date, period date")
    for x in S.known_of_period(every, df, "period", "d", {"revenue": "then"}).collect():
        seen = [(a, v) for s, p, a, v in rows if (s, p) == (x.symbol, x.period) and a <= x.d]
        assert x.then == max(seen, default=(None, None))[1]


def test_keyed_table_touches_only_its_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, n long, x double", "k", buckets=16)
    assert t.rows().count() == 0 and t.get(["a"]).collect() == []
    t.upsert(spark.createDataFrame([(f"k{i}", i, 0.5) for i in range(400)], "k string, n long, x double"), 1)
    before = set(t.rows().inputFiles())
    assert len(before) == 16
    some = spark.createDataFrame([("k7", 70, 1.0), ("k7", 71, None), ("new", 1, None), (None, 5, 5.0)], "k string, n long, x double")
    t.upsert(some, 2)
    after = set(t.rows().inputFiles())
    assert len(before - after) <= 2 and len(after - before) <= 2  # two keys, so two buckets at most are rewritten
    want = {f"k{i}": (i, 0.5) for i in range(400)} | {"k7": (71, None), "new": (1, None)}
    assert {r.k: (r.n, r.x) for r in t.rows().collect()} == want
    got = t.get(["k7", "absent"])
    assert len(got.inputFiles()) <= 2 and [(r.k, r.n) for r in got.collect()] == [("k7", 71)]
    assert "PushedFilters: [In(k" in got._jdf.queryExecution().toString() or "EqualTo(k" in got._jdf.queryExecution().toString()
    # A version written again, and one that never came to its commit, change nothing.
    t.upsert(spark.createDataFrame([("k7", 0, 0.0)], "k string, n long, x double"), 2)
    spark.createDataFrame([("k7", 9, 9.0, 1)], "k string, n long, x double, bucket int").write.partitionBy("bucket").parquet(f"{t.path}/data/version=3")
    assert {r.k: (r.n, r.x) for r in t.rows().collect()} == want
    t.upsert(spark.createDataFrame([("k8", 80, 8.0)], "k string, n long, x double"), 3)
    assert {r.k: (r.n, r.x) for r in t.rows().collect()} == want | {"k8": (80, 8.0)}
    t.upsert(spark.createDataFrame([], "k string, n long, x double"), 4)
    assert set(t.versions().values()) <= {1, 2, 3}


def test_golden_cases_and_reasons(spark, tmp_path):
    good = {
        "a": ({"case_id": "a", "query": "q", "expected_ids": ["x", "y", "x"]}, {"x": 2.0, "y": 2.0}),
        "b": ({"id": "b", "query": "", "graded_labels": {"x": 3, "y": "partially_relevant", "z": "expired", "w": 0}}, {"x": 3.0, "y": 1.0}),
        "c": ({"case_id": "c", "query": "q", "category": golden.CATEGORIES[0], "expected_subjects": ["s"], "must_not_return": ["n"]}, {"s": 2.0}),
        "d": ({"case_id": "d", "query": "q", "as_of": "2024-05-01T10:00:00+08:00", "unknown_field": 1}, {}),
    }
    bad = [
        ('{"case_id": "e", "query"', ["no case of this form"]),
        (json.dumps({"case_id": "f", "query": "q", "expected_ids": "x"}), ["no case of this form"]),
        (json.dumps({"query": "q", "category": "?"}), ["case_id is missing", "category is unknown"]),
        (json.dumps({"case_id": "g", "graded_labels": {"x": 4}, "as_of": "soon"}), ["query is missing", "a grade is unknown", "as_of is no time"]),
    ]
    lines = [json.dumps(c, ensure_ascii=False) for c, _ in good.values()] + ["", "  "] + [x for x, _ in bad]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines), encoding="utf-8")
    cases, rejected = golden.load(spark, str(tmp_path / "cases.jsonl"))
    assert {r.case_id: r.gains for r in cases.collect()} == {k: gains for k, (_, gains) in good.items()}
    assert {r.case_id: r.forbidden_ids for r in cases.collect()}["c"] == ["n"]
    assert sorted((r.value, r.reasons) for r in rejected.collect()) == sorted(bad)
