"""Nearest paths under dynamic time warping, with lower bounds instead of all distances.

A query first meets the paths of its own cell (like values in the first, middle and last row), which bounds its k-th distance. Then lots of queries meet blocks of
paths: of a block only the paths whose lower bounds do not exceed this distance are warped, in the order of their bounds, a few and later many at a time, until the next
bound exceeds the k-th distance found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import paths as P
from .stats import written_once

LOT, BLOCK, CELL = 4096, 65536, 1024  # queries of a lot, paths of a block and of a cell
SMALL_LOT, FEW_LOTS, MAX_CUTS = 64, 16, 16  # queries of a lot that is not cut further; lots of a small table; ranges of a row's values
AT_ONCE, MANY = 16, 1024  # paths to warp at first, and then


class _Block:
    """Paths (paths, rows, dims) under their keys."""

    def __init__(self, x: np.ndarray, keys: list, band: int | None):
        self.names = sorted(keys)
        order = np.argsort(x[:, 0, 0], kind="stable")
        self.x = x[order]
        self.y = np.ascontiguousarray(self.x.transpose(1, 2, 0))
        self.rank = np.empty(len(keys), int)  # equal distances go in the order of keys
        self.rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        self.rank = self.rank[order]
        self.where: dict = {}
        for place, i in enumerate(order):
            self.where.setdefault(keys[i], []).append(place)
        self.far = P.Warper(self.x[np.arange(min(MANY, len(x)))], x.shape[1], band)

    def nearest(self, a: np.ndarray, key: object, k: int, limit: float) -> tuple[list[tuple[float, int]], int]:
        """The k nearest (distance, rank of the key) up to ``limit`` without the own key, and how many paths were warped."""
        at, low = P.near_bounds(a, self.y, limit)
        if key in self.where:
            other = ~np.isin(at, self.where[key])
            at, low = at[other], low[other]
        order, best, warped = np.argsort(low, kind="stable"), [], 0
        while warped < len(order):
            some = order[warped : warped + (min(MANY, len(self.x)) if warped else AT_ONCE)]
            if low[some[0]] > limit * (1 + 1e-9):
                break
            self.far.load(self.x[at[some]])
            far, warped = self.far(a)[: len(some)], warped + len(some)
            near = np.flatnonzero(far <= np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1])
            best = sorted([*best, *[(float(far[i]), int(self.rank[at[some[i]]])) for i in near if np.isfinite(far[i])]])[:k]
            limit = min(limit, best[-1][0]) if len(best) == k else limit
        return best, warped


def nearest_paths(queries: DataFrame, corpus: DataFrame, key: str, path: str, k: int, band: int | None = None) -> DataFrame:
    """(query, neighbour, distance, rank, warped): the k paths with the smallest warping distance, the query's own key excluded; ties go to the smaller key.

    Paths are arrays of points; those of one number of rows and dimensions meet. Null and empty paths and paths with null or non-finite values take no part. ``warped`` is
    how many distances a query needed. With ``band`` rows further apart than that do not meet.
    """
    fine = F.coalesce((F.size("p") > 0) & F.forall("p", lambda x: x.isNotNull() & (F.size(x) == F.size(F.col("p")[0])) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))), F.lit(False))
    marks = [F.col("p")[0][0], F.col("p")[F.floor(F.size("p") / 2).cast("int")][0], F.col("p")[F.size("p") - 1][0]]

    def usable(df: DataFrame) -> DataFrame:
        x = df.select(F.col(key).alias("key"), F.col(path).cast("array<array<double>>").alias("p")).where(fine)
        return x.select(F.size("p").alias("rows"), F.size(F.col("p")[0]).alias("dims"), "key", F.flatten("p").alias("v"), *[m.alias(f"m{i}") for i, m in enumerate(marks)])

    asks, rows = written_once(usable(queries)), written_once(usable(corpus))
    n_asks, n_rows = asks.count(), rows.count()
    blocks, lots = max(1, -(-n_rows // BLOCK)), max(1, -(-n_asks // LOT), min(FEW_LOTS, n_asks // SMALL_LOT))
    parts = min(MAX_CUTS, round((n_rows / CELL) ** (1 / 3)))
    cuts = rows.approxQuantile([f"m{i}" for i in range(len(marks))], [i / parts for i in range(1, parts)], 0.01) if parts > 1 else [[]] * len(marks)

    def above(c: str, cuts: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(c))) if cuts else F.lit(0)

    place = F.lit(0)
    for i, c in enumerate(cuts):
        place = place * F.lit(len(c) + 1) + above(f"m{i}", c)

    same = ["rows", "dims", "cell"]
    celled = rows.withColumn("cell", place)
    sizes = celled.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / (4 * CELL)).alias("parts"))  # a large cell is met in parts
    at = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part")

    def union(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        n = max(1, min(4096, lots * blocks if "lot" in by else -(-n_rows // CELL)))
        return left.unionByName(right).repartition(n, *by).groupBy(*by)

    def met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list, _Block | None]:
        mine, names = table["asks"].to_numpy(), table["key"].to_pylist()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(names), table["rows"][0].as_py(), -1)
        others = np.flatnonzero(~mine)
        return x, np.flatnonzero(mine), names, _Block(x[others], [names[i] for i in others], band) if len(others) and mine.any() else None

    def bounded(table: pa.Table) -> pa.Table:
        x, mine, names, block = met(table)
        found = [block.nearest(x[q], names[q], k, np.inf) if block else ([], 0) for q in mine]
        limits = [best[-1][0] if len(best) == k else np.inf for best, _ in found]
        return table.select(["rows", "dims", "key", "v"]).take(pa.array(mine)).append_column("limit", pa.array(limits, pa.float64())).append_column("before", pa.array([w for _, w in found], pa.int64()))

    def run(table: pa.Table) -> pa.Table:
        x, mine, names, block = met(table)
        limits, before, first = table["limit"].to_numpy(), table["before"].to_numpy(), table["block"][0].as_py() == 0
        found = []
        for q in mine if block else ():
            best, warped = block.nearest(x[q], names[q], k, limits[q])
            found += [(names[q], block.names[i], d, 0 if j else warped + (before[q] if first else 0)) for j, (d, i) in enumerate(best)]
        columns = list(zip(*found)) or [()] * 4
        kind = table.schema.field("key").type
        return pa.table([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.float64(), pa.int64()))], names=["query", "neighbour", "distance", "warped"])

    kind = rows.schema["key"].dataType
    known = T.StructType([*[rows.schema[c] for c in ("rows", "dims", "key", "v")], T.StructField("limit", T.DoubleType()), T.StructField("before", T.LongType())])
    schema = T.StructType([T.StructField("query", kind), T.StructField("neighbour", kind), T.StructField("distance", T.DoubleType()), T.StructField("warped", T.LongType())])
    left, right = (df.join(sizes, same, "left").select(*same, at, F.lit(mine).alias("asks"), "key", "v") for df, mine in ((asks.withColumn("cell", place), True), (celled, False)))
    limited = union(left, right, *same, "part").applyInArrow(bounded, known)

    def dealt(df: DataFrame, mine: bool) -> DataFrame:
        own, other, n = ("lot", "block", blocks) if mine else ("block", "lot", lots)
        x = df.withColumns({own: F.pmod(F.xxhash64("key"), F.lit(lots if mine else blocks)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))})
        return x.select("rows", "dims", "lot", "block", F.lit(mine).alias("asks"), "key", "v", "limit", "before")

    corpus_rows = rows.withColumns({"limit": F.lit(0.0), "before": F.lit(0).cast("long")})
    found = union(dealt(limited, True), dealt(corpus_rows, False), "rows", "dims", "lot", "block").applyInArrow(run, schema)
    w = Window.partitionBy("query")
    ranked = found.withColumns({"warped": F.sum("warped").over(w), "rank": F.row_number().over(w.orderBy("distance", "neighbour"))})
    return ranked.where(F.col("rank") <= k).select("query", "neighbour", "distance", "rank", "warped")
