"""Exact nearest neighbours through a partition of space.

Rows are dealt to the nearest of some pivots (of many, to the nearest of the first ones and then to the nearest pivot around that one), so that cells stay small
while the table grows; a cell knows its size and its radius, the largest distance of a member from the pivot. A query first asks the
nearest cells that hold enough rows, which bounds its k-th distance. By the triangle inequality a row of another cell is at least (distance to the pivot -
radius) away, so the query then asks only the cells whose bound does not exceed that distance, and leaves out their rows whose own distance from the pivot
already rules them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import written_once

MAX_PIVOTS, BLOCK, LOT = 512, 4096, 4096
CELL, MAX_CELLS, MAX_NUMBERS = 2048, 65536, 2**20  # rows of a cell; cells, and the components of their pivots, on the driver
SLACK = 1 + 1e-9  # rounding of distances


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all rows of y, a block of y and a dimension at a time."""
    out = np.zeros((len(x), len(y)))
    for i in range(0, len(y), 64):
        part = out[:, i : i + 64]
        for d in range(x.shape[1]):
            gap = x[:, d, None] - y[None, i : i + 64, d]
            gap *= gap
            part += gap
    return np.sqrt(out, out)


def _usable(df: DataFrame, key: str, vector: str, width: int, *more: str) -> DataFrame:
    """(key, v, ...) of the rows whose vector has ``width`` finite components."""
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("key"), v.alias("v"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(more)])


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell``, the number of a near pivot, and ``reach``, the distance from it. Beyond MAX_PIVOTS a row looks for the nearest of the first MAX_PIVOTS,
    and then only among the pivots that are nearest to this one."""
    tops = pivots[:MAX_PIVOTS]
    owner = np.concatenate([_far(pivots[a : a + 1024], tops).argmin(axis=1) for a in range(0, len(pivots), 1024)])
    around = [np.flatnonzero(owner == t) for t in range(len(tops))]

    def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.concatenate([_far(x[a : a + 1024], tops) for a in range(0, len(x), 1024)])
        cell = far.argmin(axis=1)
        reach = far[np.arange(len(x)), cell]
        if len(pivots) > len(tops):
            order = np.argsort(cell, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                near = around[cell[own[0]]]
                inner = _far(x[own], pivots[near])
                best = inner.argmin(axis=1)
                cell[own], reach[own] = near[best], inner[np.arange(len(own)), best]
        return cell, reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, reach = placed(_matrix(batch.column(1), pivots.shape[1]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]))


def _asked(queries: DataFrame, pivots: np.ndarray, cells: dict[int, tuple[int, float, int, int]], choose: Callable[[np.ndarray, np.ndarray, float], list[int]]) -> DataFrame:
    """(key, v, limit, to_pivot, cell, part) of each query and block that it asks: ``choose`` picks from its distances to the pivots, lower bounds and limit."""
    known = sorted(cells)
    radius, parts = np.array([cells[c][1] for c in known]), [cells[c][2] for c in known]
    lot = max(1, min(256, 2**21 // len(pivots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, lot):
                some = batch.slice(a, lot)
                far = _far(_matrix(some.column(1), pivots.shape[1]), pivots)[:, known]
                limits = some.column(2).to_numpy(zero_copy_only=False)
                row, cell, part, to = [], [], [], []
                for i in range(some.num_rows):
                    for j in choose(far[i], np.maximum(0, far[i] - radius), float(limits[i])):
                        row += [i] * parts[j]
                        cell += [known[j]] * parts[j]
                        part += range(parts[j])
                        to += [far[i, j]] * parts[j]
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), some.column(2).take(at), pa.array(to, pa.float64()), pa.array(cell, pa.int32()), pa.array(part, pa.int64())], names=["key", "v", "limit", "reach", "cell", "part"])

    schema = T.StructType([queries.schema["key"], queries.schema["v"], T.StructField("limit", T.DoubleType()), T.StructField("reach", T.DoubleType()), T.StructField("cell", T.IntegerType()), T.StructField("part", T.LongType())])
    return queries.select("key", "v", "limit").mapInArrow(run, schema)


def _met(asked: DataFrame, corpus: DataFrame, k: int, width: int) -> DataFrame:
    """(query, neighbour, entity, distance, scored) of the k best (of each entity the best) of every asked block. The queries of a cell are dealt to lots by
    how many ask it, so rows travel once for LOT queries of their own cell, and not at all if none asks."""
    sizes = asked.where("part = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("lots"))  # a row for each cell
    asked, corpus = asked.join(F.broadcast(sizes), "cell"), corpus.join(F.broadcast(sizes), "cell")
    left = asked.select("cell", "part", F.pmod(F.xxhash64("key"), F.col("lots")).alias("lot"), F.lit(True).alias("asks"), "key", F.lit(None).cast(corpus.schema["_0"].dataType).alias("_0"), "v", "reach", "limit")
    right = corpus.select("cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("asks"), "key", "_0", "v", "reach", F.lit(0.0).alias("limit"))

    def nearest(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        found: list[tuple] = []
        if asks.any() and not asks.all():
            vectors = _matrix(table["v"].combine_chunks(), width)
            keys, names = table["key"].to_pylist(), table["_0"].to_pylist()
            reach, limit = table["reach"].to_numpy(), table["limit"].to_numpy()
            order = np.array(sorted(np.flatnonzero(~asks), key=lambda i: keys[i]), int)  # equal distances stay in the order of keys
            block, own = vectors[order], reach[order]
            codes: dict = {}
            group = np.array([codes.setdefault(names[i], len(codes)) for i in order], int)
            where: dict = {}
            for place, i in enumerate(order):
                where.setdefault(keys[i], []).append(place)
            for q in np.flatnonzero(asks):
                may = np.abs(own - reach[q]) <= limit[q] * SLACK
                may[where.get(keys[q], [])] = False
                at = np.flatnonzero(may)
                far = np.sqrt(((block[at] - vectors[q]) ** 2).sum(axis=1))
                near = np.argsort(far, kind="stable")
                near = near[np.sort(np.unique(group[at][near], return_index=True)[1])][:k]
                found += [(keys[q], keys[order[at[j]]], names[order[at[j]]], float(far[j]), len(at) if not n else 0) for n, j in enumerate(near)]
        columns = list(zip(*found)) or [()] * 5
        kinds = (table.schema.field("key").type, table.schema.field("key").type, table.schema.field("_0").type, pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "neighbour", "entity", "distance", "scored"])

    key = corpus.schema["key"].dataType
    schema = T.StructType([T.StructField("query", key), T.StructField("neighbour", key), T.StructField("entity", corpus.schema["_0"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("scored", T.LongType())])
    return left.unionByName(right).groupBy("cell", "part", "lot").applyInArrow(nearest, schema)


def knn(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, entity: str | None = None, pivots: int | None = None) -> DataFrame:
    """(query, neighbour, distance, rank, scored): the k nearest rows by Euclidean distance, self excluded, one hit (the best) for each entity if an
    entity column is given (a null entity is one entity). Ties go to the smaller key. ``scored`` is how many distances a query needed.

    Rows without a vector, with null or non-finite components or of another length than the first usable row (in the order of a hash of the key) take no part; keys of
    queries are distinct. ``pivots`` is the number of cells (about the root of the rows, or one for about CELL rows if these are more; MAX_CELLS at most); cells beyond BLOCK rows are met in parts.
    """
    sized = corpus.where(F.coalesce(F.size(vector) > 0, F.lit(False))).select(F.size(vector).alias("n"), F.xxhash64(key).alias("h")).orderBy("h", "n").limit(1).collect()  # one row
    width = sized[0]["n"] if sized else 1
    rows = _usable(corpus, key, vector, width, entity or key)
    n = rows.count()
    wanted = pivots or max(1, min(MAX_PIVOTS, round(n**0.5)), -(-n // CELL))
    chosen = rows.orderBy(F.xxhash64("key"), "key").select("v").limit(min(MAX_CELLS, max(MAX_PIVOTS, MAX_NUMBERS // width), wanted)).collect()  # at most MAX_CELLS rows
    centres = np.array([r["v"] for r in chosen], float).reshape(-1, width) if chosen else np.zeros((1, width))
    placed = written_once(_celled(rows, centres))
    each = placed.groupBy("cell", "_0").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")) if entity else placed.select("cell", F.lit(1).alias("n"), "reach")
    stats = each.groupBy("cell").agg(F.sum("n").alias("n"), F.max("reach").alias("radius"), F.count(F.lit(1)).alias("kinds")).collect()  # at most MAX_CELLS rows
    cells = {r["cell"]: (r["n"], r["radius"], -(-r["n"] // BLOCK), r["kinds"]) for r in stats}
    sizes = placed.sparkSession.createDataFrame([(c, p) for c, (_, _, p, _) in cells.items()], "cell int, parts long")
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))  # at most MAX_CELLS rows
    asks = written_once(_usable(queries, key, vector, width).withColumn("limit", F.lit(float("inf"))))
    counts, kinds = (np.array([cells[c][j] for c in sorted(cells)], int) for j in (0, 3))
    various = np.flatnonzero(kinds > k)  # k entities besides the query itself

    def first(far: np.ndarray, low: np.ndarray, limit: float) -> list[int]:
        """The nearest cells that hold enough rows, and the nearest one with enough entities, which bounds the k-th distance."""
        order = np.argsort(far, kind="stable")
        near = order[: int(np.searchsorted(np.cumsum(counts[order]), k + 1)) + 1].tolist()
        sure = int(various[far[various].argmin()]) if len(various) else near[0] if near else 0
        return near if sure in near or not near else [*near, sure]

    def rest(far: np.ndarray, low: np.ndarray, limit: float) -> list[int]:
        seen = set(first(far, low, limit))
        return [int(j) for j in np.flatnonzero(low <= limit * SLACK) if int(j) not in seen]

    near = written_once(_met(_asked(asks, centres, cells, first), placed, k, width))

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query", "entity").agg(F.min(F.struct("distance", "neighbour")).alias("_b")).select("query", "_b.neighbour", "_b.distance")
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)

    bound = ranked(near).where(F.col("rank") == k).select(F.col("query").alias("_q"), F.col("distance").alias("limit"))
    again = asks.drop("limit").join(bound, F.col("key") == F.col("_q"), "left").select("key", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    every = written_once(near.unionByName(_met(_asked(again, centres, cells, rest), placed, k, width)))
    scored = every.groupBy(F.col("query").alias("_q")).agg(F.sum("scored").alias("scored"))
    return ranked(every).join(scored, F.col("query") == F.col("_q")).drop("_q")
