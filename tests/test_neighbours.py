"""Neighbours through cells against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.operators import neighbours as N


def brute(keys, x, ask, k, entity=None):
    out = set()
    for q in ask:
        far = sorted((float(np.sqrt(((x[q] - x[i]) ** 2).sum())), keys[i], i) for i in range(len(keys)) if keys[i] != keys[q])
        seen, rank = set(), 0
        for d, key, i in far:
            if entity is not None and entity[i] in seen:
                continue
            seen.add(entity[i] if entity is not None else i)
            rank += 1
            out.add((keys[q], key, round(d, 9), rank))
            if rank == k:
                break
    return out


def asked(df):
    return {(r.query, r.neighbour, round(r.distance, 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("pivots,block,lot", [(None, 4096, 512), (1, 50, 7), (40, 9, 5)])
def test_equal_to_all_distances(spark, monkeypatch, pivots, block, lot):
    """Also tied distances, equal vectors, cells in parts, queries in lots, and rows that take no part."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "LOT", lot)
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-2, 3, (150, 3)), r.normal(size=(100, 3)) + 20, np.repeat([[1.0, 1, 1]], 20, axis=0)]).astype(float)
    keys, label = list(range(len(x))), [int(v) for v in r.integers(0, 9, len(x))]
    odd = [(1000, None, 1), (1001, [1.0], 1), (1002, [float("nan"), 0.0, 0.0], 1), (1003, [1.0, None, 2.0], 1), (1004, [], 1)]
    df = spark.createDataFrame([(i, v.tolist(), e) for i, v, e in zip(keys, x, label)] + odd, "i long, x array<double>, e int").repartition(4)
    some = df.where("i % 10 = 0 OR i > 999")
    ask = [i for i in keys if i % 10 == 0]
    assert asked(N.knn(some, df, "i", "x", 5, pivots=pivots)) == brute(keys, x, ask, 5)
    assert asked(N.knn(some, df, "i", "x", 4, "e", pivots)) == brute(keys, x, ask, 4, label)


def test_fewer_rows_than_neighbours_and_none(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "i long, x array<double>")
    assert N.knn(df, df, "i", "x", 9).count() == 12
    assert N.knn(df, df.limit(0), "i", "x", 3).count() == 0 and N.knn(df.limit(0), df, "i", "x", 3).count() == 0


def test_few_distances_on_a_clustered_table(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(30, 16)) * 10, 100, axis=0) + r.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    got = N.knn(df.where("i % 50 = 0"), df, "i", "x", 5)
    share = got.groupBy("query").agg(F.first("scored").alias("s")).agg(F.avg("s")).first()[0] / 3000
    assert share < 0.1 and asked(got) == brute(list(range(3000)), x, range(0, 3000, 50), 5)


def test_hashed_neighbours_equal_the_similarity_join(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from sparkseries.operators import topk

    monkeypatch.setattr(topk, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_LOT", 3)
    r = np.random.default_rng(2)
    x = np.tile(r.normal(size=(60, 5)), (4, 1))  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = topk.approx_knn(df.where("id % 10 = 0"), df, "id", "x", 2.0, 5, 1.0, tables=3)
    assert "datasetB" not in got._jdf.queryExecution().toString()  # no pairs of vectors are joined
    v = df.select("id", array_to_vector("x").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=3, seed=1).fit(v)
    pairs = model.approxSimilarityJoin(v.where("id % 10 = 0"), v, 2.0, "d").select("datasetA.id", "datasetB.id", "d").collect()
    want = set()
    for q in range(0, 240, 10):
        near = sorted((round(d, 9), b) for a, b, d in pairs if a == q and b != q)[:5]
        want |= {(q, b, d, n + 1) for n, (d, b) in enumerate(near)}
    assert {(g.query, g.neighbour, round(g.distance, 9), g["rank"]) for g in got.collect()} == want and want


def test_rows_travel_once_for_the_queries_of_their_cell(spark):
    asked = spark.createDataFrame([(q, [0.0], float("inf"), 0.0, q % 2, 0) for q in range(9_000)], "key long, v array<double>, limit double, reach double, cell int, part long")
    corpus = spark.createDataFrame([(i, [float(i)], i, i % 10, float(i), 0) for i in range(10_000, 10_100)], "key long, v array<double>, _0 long, cell int, reach double, part long")
    met = N._met(asked, corpus, 1, 1)
    assert met.count() == 9_000  # 4,500 queries of a cell make two lots
    assert {r.neighbour for r in met.collect()} == {10_000, 10_001}


@pytest.mark.parametrize("tops", [1, 7])
def test_many_cells_in_two_steps(spark, monkeypatch, tops):
    """Cells stay small while the table grows, and rows of one entity around a query do not make it ask every cell."""
    monkeypatch.setattr(N, "MAX_PIVOTS", tops)
    monkeypatch.setattr(N, "CELL", 25)
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(900, 3)) * 9, np.repeat([[40.0, 40, 40]], 60, axis=0) + r.normal(size=(60, 3)) / 50])
    label = [*(int(v) for v in r.integers(0, 50, 900)), *([99] * 60)]  # the last cell has one entity
    df = spark.createDataFrame([(i, v.tolist(), e) for i, (v, e) in enumerate(zip(x, label))], "i long, x array<double>, e int").repartition(4)
    got = N.knn(df.where("i % 10 = 0"), df, "i", "x", 3, "e")
    assert asked(got) == brute(list(range(960)), x, range(0, 960, 10), 3, label)
    assert asked(N.knn(df.where("i % 10 = 0"), df, "i", "x", 3)) == brute(list(range(960)), x, range(0, 960, 10), 3)
    cells = N._celled(N._usable(df, "i", "x", 3, "e"), x[::25]).groupBy("cell").count().collect()
    assert len(cells) > 30 and max(c["count"] for c in cells) < 200
    far = {q: int((np.sqrt(((x - x[q]) ** 2).sum(axis=1)) < 1).sum()) for q in range(900, 960, 10)}
    seen = {g["query"]: g.scored for g in got.collect()}
    assert all(n == 60 for n in far.values()) and all(seen[q] < 960 for q in seen if q < 900)
