"""Sorting, top-k and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch
from .stats import running_total

QUERY_LOT, CORPUS_BLOCK = 512, 4096


def knn(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, entity: str | None = None, same: str | None = None) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows by Euclidean distance, self excluded, one hit (the
    best) for each entity if an entity column is given. Ties go to the smaller key. With ``same``, only rows with an equal value of
    that column meet. Rows without a vector or with null or non-finite components take no part, vectors of unequal length do not meet.

    Lots of about QUERY_LOT queries meet blocks of about CORPUS_BLOCK rows, one pair of them in a task, which keeps the k best of
    its block for each query; only those are ranked.
    """
    lots, blocks = max(1, -(-queries.count() // QUERY_LOT)), max(1, -(-corpus.count() // CORPUS_BLOCK))

    def dealt(df: DataFrame, asks: bool, entity: str | None) -> DataFrame:
        own, other = (lots, blocks) if asks else (blocks, lots)
        x = df.select(F.col(key).alias("key"), F.col(entity or key).alias("entity"), F.col(vector).cast("array<double>").alias("v"), (F.col(same) if same else F.lit(0)).alias("same")).where("v is not null")
        x = x.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        names = ("own", "other") if asks else ("other", "own")
        return x.select("key", "entity", "v", "same", F.size("v").alias("width"), F.lit(asks).alias("asks"), *[F.col(c).cast("bigint").alias(n) for c, n in zip(names, ("lot", "block"))])

    rows = dealt(queries, True, None).withColumn("entity", F.lit(None).cast(corpus.schema[entity or key].dataType)).unionByName(dealt(corpus, False, entity))

    def nearest(table: pa.Table) -> pa.Table:
        asks, width = table["asks"].to_numpy(), table["width"][0].as_py()
        found: list[tuple] = []
        if width and asks.any() and not asks.all():
            vectors = pc.list_flatten(table["v"]).to_numpy().astype(float).reshape(-1, width)
            keys, names = table["key"].to_pylist(), table["entity"].to_pylist()
            order = sorted((i for i in np.flatnonzero(~asks) if np.isfinite(vectors[i]).all()), key=keys.__getitem__)  # equal distances stay in the order of keys
            block, where, codes = vectors[order], {}, {}
            for place, i in enumerate(order):
                where.setdefault(keys[i], []).append(place)
            group = np.array([codes.setdefault(names[i], len(codes)) for i in order], int)
            for i in np.flatnonzero(asks):
                far = np.sqrt(((block - vectors[i]) ** 2).sum(axis=1))
                far[where.get(keys[i], [])] = np.inf
                near = np.argsort(far, kind="stable")
                if entity:
                    near = near[np.sort(np.unique(group[near], return_index=True)[1])]
                found += [(keys[i], keys[order[j]], names[order[j]], float(far[j])) for j in near[:k] if np.isfinite(far[j])]
        columns = list(zip(*found)) or [()] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, (table.schema.field("key"), table.schema.field("key"), table.schema.field("entity"), pa.field("distance", pa.float64())))], names=["query", "neighbour", "entity", "distance"])

    kind, of = corpus.schema[key].dataType, corpus.schema[entity or key].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("neighbour", kind), T.StructField("entity", of), T.StructField("distance", T.DoubleType())])
    far = rows.groupBy("same", "width", "lot", "block").applyInArrow(nearest, schema)
    best = far.groupBy("query", "entity").agg(F.min(F.struct("distance", "neighbour")).alias("_b")).select("query", "_b.neighbour", "_b.distance") if entity else far.drop("entity")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefix_knn(queries: DataFrame, index: DataFrame, key: str, length: str, vector: str, k: int) -> DataFrame:
    """Neighbours among index rows of the query's own prefix length."""
    return knn(queries, index, key, vector, k, same=length)


def approx_knn(queries: DataFrame, corpus: DataFrame, key: str, vector: str, radius: float, k: int, bucket_length: float, tables: int = 6, seed: int = 1) -> DataFrame:
    """Neighbours within ``radius`` by locality-sensitive hashing: approximate, for corpora too large for ``knn``.

    Queries and rows of one bucket of a hash table meet in lots and blocks; a task keeps the k best of its block for each query, so candidate pairs are
    never written. Results equal those of an approximate similarity join followed by a ranking."""
    fine = lambda df: df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    as_vec = lambda df: df.withColumn("_v", array_to_vector("v"))
    a, b = fine(queries), fine(corpus)
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(as_vec(b))

    def bucketed(df: DataFrame) -> DataFrame:
        x = model.transform(as_vec(df)).select("key", "v", F.posexplode("_h").alias("table", "h"))
        return x.select("key", "v", "table", vector_to_array("h")[0].cast("long").alias("bucket"))

    a, b = bucketed(a), bucketed(b)
    both = ["table", "bucket"]
    size = lambda df, n, name: df.groupBy(both).agg(F.ceil(F.count("*") / n).alias(name))
    cut = size(a, QUERY_LOT, "lots").join(size(b, CORPUS_BLOCK, "blocks"), both)

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        own, other, names = ("lots", "blocks", ("lot", "block")) if asks else ("blocks", "lots", ("block", "lot"))
        x = df.join(cut, both).withColumn(names[0], F.pmod(F.xxhash64("key"), F.col(own)))
        return x.withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select(*both, "lot", "block", F.lit(asks).alias("asks"), "key", "v")

    def nearest(table: pa.Table) -> pa.Table:
        asks, keys, found = table["asks"].to_numpy(), table["key"].to_pylist(), []
        if asks.any() and not asks.all():
            x = pc.list_flatten(table["v"]).to_numpy().reshape(len(keys), -1)
            order = np.array(sorted(np.flatnonzero(~asks), key=lambda i: keys[i]))  # equal distances stay in the order of keys
            block, where = x[order], {}
            for place, i in enumerate(order):
                where.setdefault(keys[i], []).append(place)
            squares = (block**2).sum(axis=1)
            for q in np.array_split(np.flatnonzero(asks), max(1, asks.sum() // 64)):
                about = (x[q] ** 2).sum(axis=1)[:, None] + squares - 2 * x[q] @ block.T
                slack = 1e-9 * (1 + squares.max() + (x[q] ** 2).sum(axis=1))  # rounding of the product; what it leaves is measured exactly
                for i, row, e in zip(q, about, slack):
                    row[where.get(keys[i], [])] = np.inf
                    n = min(k, len(row)) - 1
                    some = np.flatnonzero(row <= min(np.partition(row, n)[n], radius**2) + e)
                    far = np.sqrt(((block[some] - x[i]) ** 2).sum(axis=1))
                    found += [(keys[i], keys[order[some[j]]], float(far[j])) for j in np.argsort(far, kind="stable")[:k] if far[j] < radius]
        columns, kind = list(zip(*found)) or [()] * 3, table.schema.field("key").type
        return pa.table([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.float64()))], names=["query", "neighbour", "distance"])

    kind = corpus.schema[key].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("neighbour", kind), T.StructField("distance", T.DoubleType())])
    near = dealt(a, True).unionByName(dealt(b, False)).groupBy(*both, "lot", "block").applyInArrow(nearest, schema).dropDuplicates(["query", "neighbour"])
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_n_per_group(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def even_sample(df: DataFrame, strata: str, order: list[str], n: int, total: int | None = None) -> DataFrame:
    """n evenly spaced rows (first and last with them) of each stratum's order; with ``total``, strata are taken
    in their order until it is reached."""
    w = Window.partitionBy(strata).orderBy(*order)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_c", F.count("*").over(Window.partitionBy(strata)))
    picks = F.when(F.col("_c") <= n, F.sequence(F.lit(0), F.lit(n))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("_c") - 1) / F.lit(max(n - 1, 1))).cast("int")))
    out = x.where(F.array_contains(picks, F.col("_i"))).drop("_c")
    if total is not None:
        taken = out.groupBy(strata).agg(F.count("*").alias("_n"))
        before = taken.withColumn("_b", F.sum("_n").over(Window.orderBy(strata)) - F.col("_n"))  # one row for each stratum
        inner = Window.partitionBy(strata).orderBy("_i")
        out = out.join(before, strata).withColumn("_r", F.row_number().over(inner)).where(F.col("_b") + F.col("_r") <= total).drop("_b", "_n", "_r")
    return out.drop("_i")


def cap_watchlist(df: DataFrame, added: str, key: str, max_size: int, now: Column, ttl_hours: float) -> DataFrame:
    """Entries not older than the TTL, the newest ``max_size`` of them."""
    fresh = df.where((epoch(now) - epoch(added)) / 3600 <= ttl_hours)
    return fresh.orderBy(F.desc(added), key).limit(max_size)


def latest_per_key(df: DataFrame, by: str, ts: list[str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in ts])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def leaderboard(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), key).limit(n)


def scan_batch(df: DataFrame, created: str, key: str, n: int) -> DataFrame:
    """The n youngest keys."""
    return df.orderBy(F.desc(created), key).limit(n)


def best_rank(df: DataFrame, by: str, score: str, ts: str) -> DataFrame:
    """Best-scored row of each key with its rank among keys: 1 + the number of keys with a better one (nulls last)."""
    best = df.groupBy(by).agg(F.max(score).alias("best"), F.max_by(ts, F.struct(F.col(score), -epoch(ts))).alias("best_ts"))
    counts = running_total(best.groupBy("best").agg(F.count("*").alias("_n")), "best", "_n", "_below")
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    ranks = counts.crossJoin(F.broadcast(total)).select(F.col("best").alias("_best"), (F.col("_all") - F.col("_below") - F.col("_n") + 1).cast("int").alias("rank"))
    return best.join(ranks, F.col("best").eqNullSafe(F.col("_best"))).drop("_best")
