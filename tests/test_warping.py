"""Nearest paths by lower bounds against all warping distances."""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
import pytest

from sparkseries.kernels import paths as P
from sparkseries.operators import warping as D


@pytest.mark.parametrize("band", [None, 2])
@pytest.mark.parametrize("block", [2048, 30])
def test_equal_to_all_distances(spark, monkeypatch, band, block):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "LOT", 9)
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(12, 1, 2)) * 30, 15, axis=0) + r.normal(size=(180, 10, 2)).cumsum(axis=1)
    x[20:24] = x[20]  # ties
    odd = [(500, None), (501, []), (502, [[1.0, None]] * 10), (503, [[float("nan"), 1.0]] * 10), (504, [[1.0, 2.0]])]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)] + odd, "k long, path array<array<double>>").repartition(3)
    got = D.nearest_paths(df.where("k % 6 = 0 OR k > 499"), df, "k", "path", 4, band).collect()
    want = set()
    for q in range(0, 180, 6):
        far = sorted((round(float(d), 9), i) for i, d in enumerate(P.dtw(x[q], x, band)) if i != q)
        want |= {(q, i, d, n + 1) for n, (d, i) in enumerate(far[:4])}
    assert {(g.query, g.neighbour, round(g.distance, 9), g["rank"]) for g in got} == want
    assert np.mean([g.warped for g in got]) < (60 if block > 180 else 140)  # of 179


def test_bounds_never_exceed_the_distance():
    r = np.random.default_rng(1)
    for band in (None, 0, 3):
        x, a = r.normal(size=(40, 9, 3)).cumsum(axis=1), r.normal(size=(9, 3)).cumsum(axis=0)
        assert (P.dtw_bounds(a, *P.envelopes(x, band), x[:, 0], x[:, -1]) <= P.dtw(a, x, band) + 1e-9).all()
    assert P.dtw(a, a[None], 0)[0] == 0 and np.isclose(P.dtw(a, x[:1], 0)[0], np.sqrt(((a - x[0]) ** 2).sum(axis=1)).sum())


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, [[1.0]])], "k long, path array<array<double>>")
    assert D.nearest_paths(df, df, "k", "path", 3).count() == 0 and D.nearest_paths(df.limit(0), df, "k", "path", 3).count() == 0


@pytest.mark.parametrize("dims, band", [(1, None), (3, 2)])
def test_many_paths_at_once_equal_one_by_one(dims, band):
    r = np.random.default_rng(3)
    a, x = r.normal(size=(9, dims)), r.normal(size=(200, 11, dims))
    assert np.allclose(P.dtw(a, x, band), [P.dtw(a, y, band) for y in x])


def test_classes_by_sums_of_blocks_equal_all_pairs(spark):
    from sparkseries.operators import kernels as K

    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=(6 + i % 2, 1)).tolist(), i % 3) for i in range(90)], "k long, path array<array<double>>, label int")
    want = {r.k: (r.nearest, round(r.mean_distance, 9)) for r in K.classify_by_dtw(K.pairwise(df, "k", "path", "shape", block=1000), df.select("k", "label"), "k", "label").collect()}
    plan = K.classify_by_paths(df, "k", "path", "label", block=20)
    assert {r.k: (r.nearest, round(r.mean_distance, 9)) for r in plan.collect()} == want and len(want) == 90


def test_a_path_goes_to_a_task_for_each_of_few_blocks(spark):
    from sparkseries.operators import kernels as K

    df = spark.range(20000).selectExpr("id AS k", "array(array(1D), array(2D)) AS path", "id % 3 AS label")
    tiles = K._tiles(df, "k", "path", inspect.signature(K.classify_by_paths).parameters["block"].default, "label")
    assert tiles.groupBy("k").count().agg({"count": "max"}).first()[0] <= 16 and tiles.rdd.getNumPartitions() >= 16


@pytest.mark.parametrize("dims, band", [(1, None), (1, 1), (3, None), (2, 0)])
def test_one_path_after_another_against_many(dims, band):
    r = np.random.default_rng(11)
    x = r.normal(size=(70, 6, dims))
    far = P.Warper(x, 7, band)
    for a in r.normal(size=(3, 7, dims)):
        assert np.allclose(far(a), [P.dtw(a, y, band) for y in x])
    shape = P.distances_to(x, 7, "shape", 0.3)
    assert np.allclose(shape(a), [P.shape_distance(a, y, 0.3) for y in x])


def test_resampled_paths_of_many_keys_in_one_call(spark):
    from sparkseries.operators import kernels as K

    df = spark.createDataFrame([("a", 3, 9.0), ("a", 1, 0.0), ("a", None, 11.0), ("b", 1, 4.0), (None, 2, 1.0), (None, 1, 3.0)], "k string, t int, v double")
    got = {r.k: r.path for r in K.resampled(df, "k", ["t"], ["v"], 3, "linear").collect()}
    assert got == {"a": [[0.0], [9.0], [11.0]], "b": [[4.0]] * 3, None: [[3.0], [2.0], [1.0]]}


def test_pairs_come_in_batches(spark, monkeypatch):
    from sparkseries.operators import kernels as K

    r = np.random.default_rng(9)
    x = {i: r.normal(size=(5 + i % 2, 1)) for i in range(60)}
    own = [i % 2 for i in x]
    for pairs, n in ((100, 5), (2**17, 1)):
        monkeypatch.setattr(K, "PAIRS", pairs)
        batches = list(K._pairs(pa.table({"i": [0] * 60, "j": [1] * 60, "own": own, "k": list(x), "p": [p.tolist() for p in x.values()]}), "dtw", 0.5))
        assert (len(batches) >= n if n > 1 else len(batches) == 1) and max(b.num_rows for b in batches) < pairs + 60
        assert sorted((p["a"], p["b"]) for b in batches for p in b.to_pylist()) == [(a, b) for a in x for b in x if a < b and own[a] != own[b]]
    df = spark.createDataFrame([(k, p.tolist()) for k, p in x.items()], "k long, path array<array<double>>")
    got = K.pairwise(df, "k", "path", block=20).collect()
    assert sorted((g.a, g.b) for g in got) == [(a, b) for a in x for b in x if a < b] and all(np.isclose(g.distance, P.dtw(x[g.a], x[g.b])) for g in got)


def test_a_query_warps_as_few_paths_of_many_blocks_as_of_one(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 100)
    monkeypatch.setattr(D, "LOT", 16)
    monkeypatch.setattr(D, "CELL", 40, raising=False)
    r = np.random.default_rng(17)
    x = np.repeat(r.normal(size=(24, 1, 1)) * 40, 50, axis=0) + r.normal(size=(1200, 8, 1)).cumsum(axis=1)
    x[700:705] = x[700]  # ties
    x[900:] = x[900]  # a cell in parts
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "k long, path array<array<double>>").repartition(3)
    got = D.nearest_paths(df.where("k % 50 = 0"), df, "k", "path", 3).collect()
    want = set()
    for q in range(0, 1200, 50):
        far = sorted((round(float(d), 9), i) for i, d in enumerate(P.dtw(x[q], x)) if i != q)
        want |= {(q, i, d, n + 1) for n, (d, i) in enumerate(far[:3])}
    assert {(g.query, g.neighbour, round(g.distance, 9), g["rank"]) for g in got} == want
    assert np.mean([g.warped for g in got if g.query < 900]) < 130  # 12 blocks; 16 of each at least if each starts anew


@pytest.mark.parametrize("n, dims", [(1, 1), (2, 1), (5, 1), (8, 1), (8, 2)])
def test_near_bounds_keep_all_near_paths(n, dims):
    r = np.random.default_rng(2)
    x, a = r.normal(size=(300, n, dims)).cumsum(axis=1), r.normal(size=(n, dims)).cumsum(axis=0)
    x = x[np.argsort(x[:, 0, 0])]
    far = P.dtw(a, x)
    for limit in (0.0, float(np.sort(far)[5]), np.inf):
        at, low = P.near_bounds(a, np.ascontiguousarray(x.transpose(1, 2, 0)), limit)
        assert set(np.flatnonzero(far <= limit)) <= set(at) and (low <= far[at] + 1e-9).all()
    assert set(P.near_bounds(x[7], np.ascontiguousarray(x.transpose(1, 2, 0)), 0.0)[0]) == {7}
