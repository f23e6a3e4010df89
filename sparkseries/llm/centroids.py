"""K-means of integer vectors with exact arithmetic; every assignment is an Orchard search.

Orchard search. Each centroid has the list of the others, sorted by distance from it. A search stands at a centroid and walks
its list; a centroid that is closer to the vector (or as close, with a smaller number) takes its place and the walk
starts again on that one's list. Visited centroids are marked and never measured twice. The walk ends where the next entry lies
strictly beyond twice the current distance: by the triangle inequality neither it nor any later entry can be as close.
All vectors of a batch walk together. Distances stay squared, so that all comparisons are between integers.

A round reads the vectors once; tasks hand on the sums of their clusters, and the driver holds only the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import written


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by rising distance (ties: smaller number), and these squared distances."""
    gap = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    k = len(centroids)
    order = np.array([[j for _, j in sorted((gap[i, j], j) for j in range(k) if j != i)] for i in range(k)], np.int64).reshape(k, max(k - 1, 0))
    return order, np.take_along_axis(gap, order, axis=1)


def orchard(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and how many distances were measured."""
    n, k = len(x), len(centroids)
    best = np.full(n, start)
    near = ((x - centroids[start]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, start] = True
    at, walking = np.zeros(n, np.int64), np.arange(n)
    while len(walking):
        walking = walking[at[walking] < k - 1]
        walking = walking[far[best[walking], at[walking]] <= 4 * near[walking]]
        other = order[best[walking], at[walking]]
        at[walking] += 1
        new = ~seen[walking, other]
        rows, other = walking[new], other[new]
        seen[rows, other] = True
        d = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
        closer = (d < near[rows]) | ((d == near[rows]) & (other < best[rows]))
        rows = rows[closer]
        best[rows], near[rows], at[rows] = other[closer], d[closer], 0
    return best, near, seen.sum(axis=1)


def _exact(x: np.ndarray, centroids: np.ndarray) -> np.dtype:
    """64-bit integers where four times a squared distance fits, else Python's."""
    most = max([0, *(int(np.abs(y).max()) for y in (x, centroids) if y.size)])
    return np.dtype(np.int64) if 16 * max(x.shape[1], 1) * most * most < 1 << 63 else np.dtype(object)


def _searched(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    order, far = neighbour_lists(centroids.astype(object))
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            kind = _exact(x, centroids)
            x = x.astype(kind)
            yield (part, x, *orchard(x, centroids.astype(kind), order, far.astype(kind)))


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(rid, cluster, distance, measured) of ``vectors(rid, x)``: the nearest centroid, its squared distance and the number of distances measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, near, count in _searched(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(near.tolist(), pa.int64()), pa.array(count.astype(np.int32))], names=["rid", "cluster", "distance", "measured"])

    schema = T.StructType([vectors.schema["rid"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("measured", T.IntegerType())])
    return vectors.select("rid", "x").mapInArrow(run, schema)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, d), object), np.zeros(k, np.int64)
        for _, x, best, _, _ in _searched(batches, centroids):
            for c in np.unique(best):
                own = x[best == c]
                sums[c] += own.sum(axis=0)
                n[c] += len(own)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, d).astype(np.int32)), pa.array(np.tile(np.arange(d), len(some)).astype(np.int32)), pa.array(sums[some].ravel().tolist(), pa.int64()), pa.array(np.repeat(n[some], d))], names=["cluster", "i", "total", "n"])

    found = vectors.select("rid", "x").mapInArrow(run, "cluster int, i int, total long, n long").groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # k x d rows
    out = centroids.astype(object)
    for r in found:
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return out.astype(np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", id_col: str = "vec_id", vector_col: str = "vector", dims: int = 64) -> DataFrame:
    """(rid, cluster, distance, measured, cluster_inertia, inertia, centroid_sha256) of each usable row of ``vectors``.

    ``vector_col`` holds integers. Centroids start as the ``k`` vectors whose id has the smallest sha256 of ``<salt>:<id>`` (all, if there are
    fewer; ties by the vector), are moved ``rounds`` times, and every vector is assigned once more. Rows whose
    vector is null, holds nulls or has another length than ``dims`` take no part; null ids hash as ''; repeated rows
    count each; an empty table gives an empty result; other columns are not read. Results are exact; a distance, a sum of a task
    or an inertia beyond the range of a long is an error. ``centroid_sha256`` is the digest of the final centroid's components, joined by commas.
    """
    usable = (F.size(vector_col) == dims) & ~F.exists(vector_col, lambda v: v.isNull())
    held = written(vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("rid"), F.col(vector_col).cast("array<bigint>").alias("x")), "vectors")
    first = held.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("rid").cast("string"), F.lit(""))), 256), "x").limit(k).collect()  # k rows
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(held, centroids)
    found = written(assign(held, centroids), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    whole = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = found.sparkSession.createDataFrame([(c, sums[c], whole, digests[c]) for c in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("rid", "cluster", "distance", "measured", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
