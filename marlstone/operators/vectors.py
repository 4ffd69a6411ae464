"""An index of vectors by inverted lists: near lists are probed, and an exact search goes on where bounds leave a chance.

Centroids are fitted on a bounded sample; every vector is then put into the list of its nearest centroid, a partition of a
Parquet table. A query visits the lists whose centroids are nearest. The exact search takes the worst score found so far
and visits each further list that may hold a better one: a vector is at most as near to the query as the angle to the
centroid less the list's radius allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.retrieval import best_of, dense_top_k, units
from marlstone.sources.stores import shared_path

#: Vectors that the centroids are fitted on, rounds of fitting, and most lists: what the driver holds.
SAMPLE, ROUNDS, LISTS = 20_000, 8, 1024
#: Vectors and queries that meet in one group of a task.
PART = 10_000
#: Queries by which the number of probes is tuned.
TRIED = 200
#: Scores are rounded to 6 places; a bound that close to the threshold is no reason to leave a list out.
MARGIN = 2e-6

_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    path: str
    centroids: np.ndarray
    #: Cosine of each list's farthest vector to its centroid, and the list's size; 0 where a list is empty.
    reach: np.ndarray
    sizes: np.ndarray


def fit(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centroids of unit length from the SAMPLE vectors of smallest hash, by k-means over angles. By default there are as
    many lists as the square root of the number of vectors, LISTS at most. No vector gives one list."""
    n = vectors.count()
    lists = max(1, min(lists or int(n**0.5), LISTS))
    s = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    _, v = units(s["vec_id"], s["embedding"])
    if not len(v):
        return np.zeros((1, 0))
    centroids = v[np.random.default_rng(0).permutation(len(v))[:lists]]
    for _ in range(ROUNDS):
        sums = np.zeros_like(centroids)
        np.add.at(sums, (v @ centroids.T).argmax(axis=1), v)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centroids)
    return centroids


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """An index of all ``vectors`` (vec_id, embedding), in the shared folder. Null and zero vectors are near to nothing and
    are left out. Vectors of one list are dealt over eight tasks when they are written."""
    spark = vectors.sparkSession
    centroids = fit(vectors, lists)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, v = units(b["vec_id"], b["embedding"])
            if len(ids):
                near = v @ centroids.T
                at = near.argmax(axis=1)
                yield pd.DataFrame({"vec_id": ids, "v": list(v), "near": near[np.arange(len(at)), at], "list": at})

    path = shared_path(spark, "lists")
    rows = vectors.select("vec_id", "embedding").mapInPandas(listed, "vec_id long, v array<double>, near double, list int")
    rows.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("list").parquet(path)
    reach, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    if centroids.shape[1]:
        for r in _table(spark, path).groupBy("list").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect():  # LISTS rows at most
            reach[r["list"]], sizes[r["list"]] = r["near"], r["n"]
    return Index(path, centroids, reach, sizes)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, v array<double>, near double, list int").parquet(path)


def _visit(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """The best ``k`` of each query in each group that it meets. ``visits`` (query_id, q, list) is a stored table. Long lists
    and lists of many visits are split, and each part of one meets each part of the other."""
    spark = visits.sparkSession
    asked = {r["list"]: r["n"] for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    splits = [(c, max(1, -(-int(index.sizes[c]) // PART)), -(-n // PART)) for c, n in asked.items()]
    split = F.broadcast(spark.createDataFrame(splits, "list int, parts int, q_parts int"))  # LISTS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    left = visits.join(split, "list").withColumn("q_part", part("query_id", "q_parts")).select("query_id", "q", "list", "q_part", every("parts").alias("part"))
    held = _table(spark, index.path).where(F.col("list").isin(sorted(asked)))  # other lists' files are not opened
    right = held.join(split, "list").withColumn("part", part("vec_id", "parts")).select("vec_id", "v", "list", "part", every("q_parts").alias("q_part"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(a) and len(b):
            b = b.sort_values("vec_id")
            ids, v = b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy())
            for at in range(0, len(a), 500):
                some = a.iloc[at : at + 500]
                score = np.round(np.stack(some["q"].to_numpy()) @ v.T, 6)
                kept = best_of(score, k)
                out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), kept.shape[1]), "vec_id": ids[kept].ravel(), "score": np.take_along_axis(score, kept, axis=1).ravel()}))
        return pd.concat(out)

    keys = ["list", "part", "q_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probes_for(vectors: DataFrame, index: Index, k: int, recall: float = 0.95) -> int:
    """The fewest lists a query has to visit for that recall of its ``k`` nearest, measured: the TRIED vectors of smallest
    salted hash are compared with all vectors, and the places of their neighbours' lists are counted."""
    tried = vectors.select(F.col("vec_id").alias("query_id"), "embedding").orderBy(F.xxhash64("query_id", F.lit("tried")), "query_id").limit(TRIED)
    own = tried.toPandas()
    ids, q = units(own["query_id"], own["embedding"])
    if not len(ids):
        return 1
    near = dense_top_k(tried, vectors, k).select("query_id", "vec_id")
    where = near.join(_table(vectors.sparkSession, index.path).select("vec_id", "list"), "vec_id").select("query_id", "list").toPandas()  # TRIED times k rows
    place = np.argsort(np.argsort(-np.where(index.sizes > 0, q @ index.centroids.T, -2.0), axis=1, kind="stable"), axis=1)
    met = np.bincount(place[np.searchsorted(ids, where["query_id"]), where["list"]], minlength=len(index.sizes))
    return int(np.searchsorted(np.cumsum(met), recall * len(where))) + 1


def search(queries: DataFrame, index: Index, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest by cosine of each query (query_id, embedding; ids differ).

    Without ``exact`` only the ``probes`` nearest lists are visited. With it all lists follow that may hold a vector as near
    as the worst of those ``k``: the result is that of comparing all. Ties go by vec_id. An empty index gives no row.
    """
    spark = queries.sparkSession
    centroids, sizes = index.centroids, index.sizes
    if not sizes.any():
        return spark.createDataFrame([], _FOUND + ", rank int")
    radius = np.arccos(np.clip(index.reach, -1, 1))
    probes = min(probes, int((sizes > 0).sum()))

    def lists_of(further: bool):
        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, q = units(b["query_id"], b["embedding"])
                if not len(ids):
                    continue
                near = np.where(sizes > 0, q @ centroids.T, -2.0)
                first = np.zeros(near.shape, dtype=bool)
                np.put_along_axis(first, best_of(near, probes), True, axis=1)
                if further:
                    worst = b.set_index("query_id")["worst"].reindex(ids).fillna(-2.0).to_numpy()
                    bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0))
                    first = ~first & (sizes > 0) & (bound >= worst[:, None] - MARGIN)
                row, at = np.nonzero(first)
                if len(row):
                    yield pd.DataFrame({"query_id": ids[row], "q": list(q[row]), "list": at})

        return visits

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    asked, schema = queries.select("query_id", "embedding"), "query_id long, q array<double>, list int"
    found = _visit(stored(asked.mapInPandas(lists_of(False), schema), "visits"), index, k)
    if exact:
        found = stored(_ranked(found, k).drop("rank"), "found")
        worst = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
        again = asked.join(worst, "query_id", "left").mapInPandas(lists_of(True), schema)
        found = found.unionByName(_visit(stored(again, "visits"), index, k))
    return _ranked(found, k)
