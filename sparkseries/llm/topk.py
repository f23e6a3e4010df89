"""Exact top-k search by inner product: Fagin's threshold algorithm in blocks.

Vectors are dealt into blocks of bounded size by a hash of their id, queries likewise, and every query block
meets every vector block of its width once. In a block each dimension has a list sorted by value; a query reads the
list of dimension d from the top if its own component is positive and from the bottom if it is
negative (sorted access). After each round of accesses the vectors seen are scored in full (random access), and
the threshold is the score of a vector that would have, in every dimension, the value last read there.
When the threshold cannot reach the k-th best score known, no unseen vector can, and the query
stops. The first block of each width is searched alone; its k-th scores are the bound that all other blocks start from. Reads
go on in rounds of fourfold depth; a query that never stops early has read whole lists, so its result is exact as well.
Partial results of blocks are merged for each query.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._state import written

BLOCK_ROWS, QUERY_ROWS, FIRST_DEPTH = 8192, 8192, 8
NO_BOUND = -(1 << 63)
FOUND = "query_id bigint, vec_id bigint, score bigint, seen bigint"


def usable(vector: Column, width: int | None = None) -> Column:
    """Vectors without null or non-finite components (and of the given width)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) == width if width else F.lit(True))


def exact_type(x: np.ndarray, q: np.ndarray) -> type:
    """A type in which all products and sums of the rows are exact: float (fast), long, or Python's integers."""
    most = [max(int(a.max()), -int(a.min())) if a.size else 0 for a in (x, q)]
    reach = most[0] * most[1] * x.shape[1]
    return np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, bound: np.ndarray | None = None, first: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best in the block, and how many vectors each query scored.

    Rows with the query's id are left out, and so may be scores below ``bound``. ``x`` and ``q`` hold longs; scores are exact
    and raise OverflowError if they are no longs.
    """
    kind, (n, d) = exact_type(x, q), x.shape
    order = np.argsort(x, axis=0, kind="stable")  # ascending lists of all dimensions
    place = np.empty((d, n), np.int32)  # of each vector in each ascending list
    for j in range(d):
        place[j, order[:, j]] = np.arange(n)
    x, q = x.astype(kind), q.astype(kind)
    values = np.take_along_axis(x, order, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low = kind(NO_BOUND) if kind is not object else -(1 << 200)
    bound = np.full(len(q), low) if bound is None else np.array([low if b == NO_BOUND else b for b in bound.tolist()], kind)
    active, scored = np.arange(len(q)), np.zeros(len(q), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = min(first, n)
    while len(active) and n:
        threshold = up[active] @ values[n - depth] + down[active] @ values[depth - 1]
        stay = []
        for lot in np.array_split(np.arange(len(active)), ceil(len(active) * n / 4_000_000)):
            rows = active[lot]
            top, bottom = (place >= n - depth).astype(np.float32), (place < depth).astype(np.float32)
            seen = ((q[rows] > 0).astype(np.float32) @ top + (q[rows] < 0).astype(np.float32) @ bottom) > 0
            if depth == n:
                seen[:] = True
            used = np.flatnonzero(seen.any(axis=0))
            mine = seen[:, used] & (ids[used][None, :] != q_ids[rows][:, None])
            score = np.where(mine, q[rows] @ x[used].T, low)
            kth = np.sort(score, axis=1)[:, -k] if score.shape[1] > k and kind is object else np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(rows), low)
            kth = np.maximum(kth, bound[rows])
            done = (kth > threshold[lot]) | (depth == n)  # at equality an unseen smaller id could tie
            a, b = np.nonzero(done[:, None] & mine & (score >= kth[:, None]))
            out.append((rows[a], used[b], score[a, b]))
            scored[rows[done]] = mine[done].sum(axis=1)
            stay.append(rows[~done])
        active = np.concatenate(stay)
        depth = min(n, depth * 4)
    a, b, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int),) * 3
    if kind is object and any(not NO_BOUND <= v < 1 << 63 for v in s):
        raise OverflowError("an inner product does not fit in a long")
    s = s.astype(np.int64)
    rank = np.lexsort((ids[b], -s, a))
    a, b, s = a[rank], b[rank], s[rank]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    return a[nth < k], b[nth < k], s[nth < k], scored


def _longs(t: pa.Table) -> np.ndarray:
    return t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def partial_results(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """FOUND: the k best of every query in every block; ``seen`` is the number of vectors that the query scored there."""
    pick = lambda df: df.withColumn("width", F.size("v"))
    vectors, queries = pick(vectors), pick(queries)
    blocks = vectors.groupBy("width").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    lots = queries.groupBy("width").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("lots"))
    sizes = written(blocks.join(lots, "width"), "widths")  # a row for each width
    part = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    every = lambda n, a=0: F.explode(F.expr(f"sequence({a}, {n} - 1)"))

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score", "seen")})
        ids, q_ids, bound = x["id"].to_numpy(), q["id"].to_numpy(), q["bound"].to_numpy()
        a, b, s, seen = search_block(_longs(x), ids, _longs(q), q_ids, k, bound)
        return pa.table({"query_id": pa.array(q_ids[a]), "vec_id": pa.array(ids[b]), "score": pa.array(s), "seen": pa.array(seen[a])})

    def search(left: DataFrame, right: DataFrame) -> DataFrame:
        names = ["width", "block", "lot"]
        return left.select("id", "v", *names).groupBy(*names).cogroup(right.select("id", "v", "bound", *names).groupBy(*names)).applyInArrow(run, FOUND)

    left = vectors.join(sizes, "width").withColumn("block", part("blocks")).withColumn("lot", every("lots"))
    right = queries.join(sizes, "width").withColumn("lot", part("lots"))
    head = written(search(left.where("block = 0"), right.withColumn("block", F.lit(0)).withColumn("bound", F.lit(NO_BOUND))), "head")
    bounds = head.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("id", "kth")
    known = right.join(bounds, "id", "left").withColumn("bound", F.coalesce("kth", F.lit(NO_BOUND))).where("blocks > 1").withColumn("block", every("blocks", 1))
    return head.unionByName(search(left.where("block > 0"), known))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every row of ``queries``.

    Both frames hold a bigint id and an array of longs. Scores are exact; one that is no long raises an error. A query meets the
    vectors of its own width; vectors with its id are no candidates. Ties go to the smaller id; repeated rows of
    ``vectors`` are candidates as often as they occur, of ``queries`` with one id the smallest vector counts. With fewer
    candidates than k all are returned. Null ids and vectors that are null, empty or hold nulls are ignored. Other columns
    are not read. Empty tables give no rows.
    """
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & usable(F.col("v")))
    found = partial_results(pick(vectors), pick(queries).groupBy("id").agg(F.min("v").alias("v")), k, block_rows, query_rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
