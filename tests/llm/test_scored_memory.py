"""What the two scoring stages of the pipeline make of texts doesn't grow with a batch, and their rows are stored."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import quality, toxicity


def test_texts_scored_at_once(spark):
    class Counting(toxicity.Chain):  # a probability that tells how many texts came together
        def matrix(self, found):
            return np.full((len(found), 1), len(found))

        def predict(self, x):
            return x / 1e4

    class Model:
        def score(self, x):
            return np.full(len(x), 1 - len(x) / 1e4)

    docs = spark.range(1500, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(None).alias("a`b"))
    for kept in (toxicity.keep_clean(docs, Counting({}, ()), 0.0501), quality.keep_good(docs, Model(), 0.9499)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and kept.count() == 1500
        assert "Python" not in kept._jdf.queryExecution().toString()
