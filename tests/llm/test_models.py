"""Toxicity and quality: held-out accuracy, awkward rows, and that only labels and texts are used."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def held_out(ids):
    return np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in ids])


@pytest.fixture(scope="module")
def truth(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas().drop_duplicates("doc_id")


def test_toxicity_held_out(spark, truth):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = toxicity.score(docs, chain).toPandas().merge(truth[["doc_id", "toxic"]].rename(columns={"toxic": "y"}), on="doc_id")
    got = got[held_out(got.doc_id) & got.y.notna()]
    # About a tenth of the toxic labels stand on junk without any toxic word, which no text model can tell.
    assert got.toxic[got.y == 1].mean() > 0.85 and got.toxic[got.y == 0].mean() < 0.01
    assert len(chain.links) == len(got.category_scores.iloc[0]) + 1


def test_quality_held_out(spark, truth):
    got = queries.op7_quality(spark, SF).toPandas().merge(truth[["doc_id", "quality"]], on="doc_id")
    assert (got.held_out.to_numpy() == held_out(got.doc_id)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    got = got[got.held_out & got.quality.notna()]
    assert (got.predicted == got.quality).mean() > 0.98


def test_sample_leaves_the_fold_out(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = labelled.labelled_sample(docs, labels, "quality", 30, fold_of=5).collect()
    assert len(rows) == 60 and not held_out([r.doc_id for r in rows]).any()
    assert {r.doc_id for r in rows} == {r.doc_id for r in labelled.labelled_sample(docs.repartition(7), labels, "quality", 30, fold_of=5).collect()}


def test_awkward_rows(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (5, 1, 0), (9, 0, 1), (9, 1, 0)], LABELS)
    chain = toxicity.train(clashing, labels)
    model = quality.train(clashing, labels)
    assert toxicity.score(awkward, chain).where("toxic_score between 0 and 1").count() == awkward.count()
    assert quality.score(awkward, model).where("score between 0 and 1").count() == awkward.count()
    kept = quality.keep_good(toxicity.keep_clean(clashing, chain, 1.1), model, -1)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    equal = {r.score for r in quality.score(awkward.where("doc_id in (5, 6)"), model).collect()}
    assert len(equal) == 1
    for docs, known in ((empty, labels), (awkward, labels.limit(0)), (empty, labels.limit(0)), (awkward, labels.where("doc_id = 1"))):
        chain, model = toxicity.train(docs, known), quality.train(docs, known)
        assert toxicity.score(awkward, chain).count() == quality.score(awkward, model).count() == awkward.count()
        assert toxicity.score(empty, chain).count() == quality.score(empty, model).count() == 0


def test_chain_feeds_earlier_probabilities():
    r = np.random.default_rng(0)
    x = (r.random((600, 4)) < 0.2).astype(float)
    y = ((x[:, 0] + x[:, 1]) > 0).astype(float)
    chain = toxicity.fit_chain({k: i for i, k in enumerate("abcd")}, x, y, np.arange(600) % 5)
    p = chain.predict(x)
    assert p.shape[1] == len(chain.links) and [len(w) for w in chain.links] == [5 + k for k in range(len(chain.links))]
    assert ((p[:, -1] >= 0.5) == (y == 1)).mean() > 0.98


def test_discriminant_equals_densities():
    r = np.random.default_rng(1)
    x = np.r_[r.normal(0, 1, (300, 3)), r.normal(1, 2, (300, 3))]
    y = np.r_[np.zeros(300), np.ones(300)].astype(int)
    m = quality.fit(x, y)
    z = (x - m.centre) / m.scale
    logs = []
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
        d = z - m.means[k]
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = m.prior + m.temper * (logs[1] - logs[0])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-odds)), atol=1e-6)
