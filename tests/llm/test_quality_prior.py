"""The prior of the quality classifier comes from the same labels as its sample."""

import math
import zlib

from pyspark.sql import functions as F

from marlstone.llm import quality


def test_held_out_labels_do_not_move_the_prior(spark):
    ids = range(100)
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
    docs = spark.createDataFrame([(i, f"word {i} text") for i in ids], "doc_id long, text string")
    # All held-out labels are 1; a third of the others are.
    labels = spark.createDataFrame([(i, 1 if o else int(i % 3 == 0), 0) for i, o in zip(ids, out, strict=True)], "doc_id long, quality int, toxic int")
    used = [int(i % 3 == 0) for i, o in zip(ids, out, strict=True) if not o]
    model = quality.train(docs, labels, fold_of=5)
    assert any(out) and math.isclose(model.prior, math.log((sum(used) + 1) / (len(used) - sum(used) + 1)))


def test_held_out_labels_change_no_score(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    repeated = labels.unionByName(labels.where("quality = 1"))
    a, b, c = (sorted(map(tuple, quality.score(docs, quality.train(docs, x, fold_of=5)).collect())) for x in (labels, flipped, repeated))
    assert a == b == c and len({s for _, s in a}) > 5
