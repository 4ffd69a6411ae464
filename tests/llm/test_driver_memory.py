"""What the driver of the pipeline holds: plans of few steps in the near-copy stage, no copies of the training matrix."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import shingles, toxicity
from marlstone.llm.session import hot_list, join_sized


def test_plan_of_both_sides(spark):
    pairs = spark.range(300).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("x"))
    got = shingles._with_both(pairs, rows, "x")
    assert {tuple(r) for r in got.select("a", "b", "x_a", "x_b").collect()} == {(k, 0, k % 7, 0) for k in range(300)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4


def test_hot_keys_known_before(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") < 5000, -1).when(F.col("id") % 100 == 0, None).otherwise(F.col("id") % 900).alias("k"))
    sized = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_list(sized, "k", "n")
    assert hot == [-1] and hot_list(sized.where("k >= 0"), "k", "n") == [] and hot_list(sized.where("false"), "k", "n") == []
    for how in ("left", "inner"):
        for some in (sized, sized.where("k >= 0")):
            got = join_sized(rows, some, "k", "n", F.xxhash64("id"), how, hot_list(some, "k", "n"))
            other = join_sized(rows, some, "k", "n", F.xxhash64("id"), how)
            assert got.columns == other.columns and sorted(map(repr, got.collect())) == sorted(map(repr, other.collect()))


def test_a_chain_is_fitted_without_copies():
    r = np.random.default_rng(0)
    x = (r.random((12_000, 200)) < 0.02).astype(np.int8)
    y = (x[:, :5].any(axis=1)).astype(float)
    tracemalloc.start()
    try:
        chain = toxicity.fit_chain({str(k): k for k in range(200)}, x, y, np.arange(len(x)) % 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15e6
    assert ((chain.predict(x[:1000].astype(float))[:, -1] > 0.5) == (y[:1000] == 1)).all()
