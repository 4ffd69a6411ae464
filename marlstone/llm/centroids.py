"""Centroid clustering of integer vectors, with block-norm screening of the centroids.

A vector is kept whole and compressed: a step, codes of four bits a component, and the norms of what the codes leave, one for
each of SEGMENTS segments. By the Cauchy-Schwarz inequality on each segment the inner product with a centroid is at most that
of the codes plus the sum of residual norm times the centroid's norm; so squared distances have lower bounds from compressed
vectors alone. Only centroids whose bound doesn't exceed the exact distance of the one with the least bound get an exact
integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import stored

SCALE, SEGMENTS = 256, 8
#: Components beyond this have squared distances that a long may not hold.
MOST = 1 << 27
VECTOR_SCHEMA = "vec_id long, x binary, code binary, step long, rest binary, square long"


def compress(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (two of four bits in a byte), step and the segments' residual norms, rounded up, of the rows of ``x``."""
    step = np.maximum(1, -(-np.abs(x).max(axis=1) // 7))
    code = np.floor_divide(2 * x + step[:, None], 2 * step[:, None])  # rounded: within -7 to 7
    rest = (x - code * step[:, None]).reshape(len(x), SEGMENTS, -1)
    norms = np.nextafter(np.sqrt((rest * rest).sum(axis=2)).astype(np.float32), np.float32(np.inf))
    shifted = (code + 8).astype(np.uint8)
    return shifted[:, ::2] << 4 | shifted[:, 1::2], step, norms


def quantised(vectors: DataFrame, components: int, id_col: str, vector_col: str) -> DataFrame:
    """VECTOR_SCHEMA of the rows whose vector has exactly ``components`` finite components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.floor(SCALE * np.stack([np.asarray(x, dtype=float) for x in b["v"]]))
            if np.abs(v).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} / {SCALE}")
            x = v.astype(np.int64)
            code, step, rest = compress(x)
            yield pd.DataFrame(
                {"vec_id": b["vec_id"], "x": [r.tobytes() for r in x.astype("<i4")], "code": [r.tobytes() for r in code], "step": step, "rest": [r.tobytes() for r in rest], "square": (x * x).sum(axis=1)}
            )

    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = (F.size("v") == components) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(whole, F.lit(False))).mapInPandas(run, VECTOR_SCHEMA)


def unpack(b: pd.DataFrame, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grid = lambda c, kind: np.frombuffer(b"".join(b[c]), dtype=kind).reshape(len(b), -1)
    packed = grid("code", np.uint8)
    code = np.empty((len(b), components), dtype=np.int64)
    code[:, ::2], code[:, 1::2] = packed >> 4, packed & 15
    return grid("x", "<i4").astype(np.int64), code - 8, b["step"].to_numpy(np.int64), grid("rest", np.float32).astype(float), b["square"].to_numpy(np.int64)


def nearest(x: np.ndarray, code: np.ndarray, step: np.ndarray, rest: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster, squared distance, and how many exact distances were taken."""
    c = centroids.astype(float)
    norms = np.sqrt((c * c).reshape(len(c), SEGMENTS, -1).sum(axis=2))
    outer = square[:, None].astype(float) + (c * c).sum(axis=1)
    inner = (code @ c.T) * step[:, None] + rest @ norms.T
    # Both are rounded; the bound gives way by far more than that.
    bound = outer - 2 * inner - 1e-9 * (outer + 2 * np.abs(inner)) - 1
    rows = np.arange(len(x))
    first = bound.argmin(axis=1)
    apart = x - centroids[first]
    best = (apart * apart).sum(axis=1)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, first] = best
    open_row, open_col = np.nonzero(bound <= best[:, None])
    for at in range(0, len(open_row), 100_000):
        i, j = open_row[at : at + 100_000], open_col[at : at + 100_000]
        apart = x[i] - centroids[j]
        exact[i, j] = (apart * apart).sum(axis=1)
    cluster = exact.argmin(axis=1)  # the smaller number of equal ones
    return cluster, exact[rows, cluster], len(open_row)


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``salt`` and id, in that order; of equal ids those of lesser bytes first."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], dtype="<i4") for r in rows], dtype=np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, components: int) -> np.ndarray:
    """Each centroid that has vectors replaced by their exact floored mean. A batch sends one row of sums per cluster and
    component, so what the driver gets is bounded by k times the components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            if len(b):
                parts = unpack(b, components)
                cluster, _, _ = nearest(*parts, centroids)
                np.add.at(total, cluster, parts[0])
                count += np.bincount(cluster, minlength=len(centroids))
        some = np.nonzero(count)[0]
        yield pd.DataFrame({"cluster": np.repeat(some, components), "at": np.tile(np.arange(components), len(some)), "total": total[some].ravel(), "n": np.repeat(count[some], components)})

    sums = kept.mapInPandas(run, "cluster int, at int, total long, n long").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["at"]] = r["total"] // r["n"]
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``components`` components, none null or not finite; each becomes floor(256 * x). Ties go to
    the smaller cluster. Repeated rows are vectors of their own; a null id counts as an empty text where ids are hashed. With
    fewer than ``k`` vectors there are as many centroids; an empty table gives an empty result. Other columns aren't read. A
    component beyond 2**19 stops the job, as squared distances might not fit a long. Quantised vectors are written once to
    the shared folder; each round reads them again and sends the driver k times the components sums.
    """
    if components % (2 * SEGMENTS):
        raise ValueError(f"components must be a multiple of {2 * SEGMENTS}")
    spark = vectors.sparkSession
    kept = stored(quantised(vectors, components, id_col, vector_col), "quantised")
    centroids = first_centroids(kept, k, salt).reshape(-1, components)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids, components)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, d, _ = nearest(*unpack(b, components), centroids)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": c, "distance": d})

    given = stored(kept.mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned")
    own = given.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows at most
    total = own.agg(F.sum("cluster_inertia").alias("inertia"))
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    facts = own.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))
    return given.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
