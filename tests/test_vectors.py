"""The index of vectors against comparing all: recall of the probes, the exact search, awkward rows."""

import numpy as np
import pytest

from marlstone.operators import vectors
from marlstone.operators.retrieval import dense_top_k


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_recall_of_probes(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    index = vectors.build(e)
    assert index.sizes.sum() == e.count()
    want = {(r.query_id, r.vec_id) for r in dense_top_k(asked, e, 10).collect()}
    probes = vectors.probes_for(e, index, 10)
    got = {(r.query_id, r.vec_id) for r in vectors.search(asked, index, 10, probes=probes).collect()}
    print("recall", len(want & got) / len(want), "by", probes, "of", len(index.sizes), "lists")
    assert len(want & got) >= 0.9 * len(want) and probes < len(index.sizes)


@pytest.mark.parametrize("part", [10_000, 7])
def test_exact_search_equals_comparing_all(spark, part, monkeypatch):
    monkeypatch.setattr(vectors, "PART", part)
    rng = np.random.default_rng(part)
    hot = np.repeat(rng.normal(size=(1, 6)), 60, axis=0)  # equal vectors: one list of a third of the rows
    data = np.r_[rng.normal(size=(120, 6)), hot].tolist()
    given = [(k, v) for k, v in enumerate(data)] + [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    asked = e.where("vec_id % 4 = 0 or vec_id >= 900").selectExpr("vec_id AS query_id", "embedding")
    index = vectors.build(e, lists=12)
    assert index.sizes.sum() == 180
    assert rows(vectors.search(asked, index, 5, probes=1, exact=True)) == rows(dense_top_k(asked, e, 5))
    # More are asked for than the first list holds.
    assert rows(vectors.search(asked.limit(6), index, 150, probes=1, exact=True)) == rows(dense_top_k(asked.limit(6), e, 150))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = some.selectExpr("vec_id AS query_id", "embedding")
    assert vectors.search(asked, vectors.build(none), 3).count() == 0
    assert vectors.search(asked.where("query_id = 0"), vectors.build(some), 3, exact=True).count() == 0
    assert [r.vec_id for r in vectors.search(asked, vectors.build(some), 1).orderBy("query_id").collect()] == [1, 2]
