"""Models on tables whose answer is known, and invariants of fits on all components."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.kernels import dsp
from sparkseries.operators import cluster, kernels, ml

SF = "/root/testdata/sf0.01"
HOW = {"trees": 4, "depth": 3}


@pytest.fixture(scope="module")
def table(spark):
    """Two features decide everything: a > 0 is the class, b's sign adds a third one; noise says nothing."""
    r = np.random.default_rng(8)
    x = np.column_stack([r.choice([-2.0, -1.0, 1.0, 2.0], (600, 2)), r.normal(size=600)]).tolist()  # few values, so that bins fall between them
    rows = [(f"k{i % 30}", i, a, b, c, int(a > 0), int(a > 0) + int(a > 0 and b > 0), 4.0 if a > 0 else 1.0) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, id long, a double, b double, noise double, y int, cls int, mult double")
    return ml.group_folds(df, "k", 3).cache()


COLS = ["a", "b", "noise"]


def test_binary_out_of_fold(table):
    got = ml.train_binary(table, COLS, "y", folds=3, **HOW).collect()
    assert len(got) == 600 and all((r.p > 0.5) == (r.y == 1) for r in got)


def test_multiclass_out_of_fold(table):
    got = ml.train_multiclass(table, COLS, "cls", folds=3, **HOW).collect()
    assert len(got) == 600 and np.mean([r.pred == r.cls for r in got]) > 0.97


def test_forward_multiple_importances_filter_and_unseen_keys(spark, table):
    got = ml.train_forward_multiple(table, ["a"], ["b"], "mult", folds=3, **HOW).collect()
    assert len(got) == 600 and all(abs(r.pred - r.mult) < 0.2 for r in got)
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(labelCol="y", weightCol="weight", maxIter=4, maxDepth=3, seed=1).fit(ml.assembled(ml.balanced(table, "y"), COLS))
    ranks = ml.importances(model, COLS, spark).orderBy("rank").collect()
    assert [r.feature for r in ranks][0] == "a" and abs(sum(r.importance for r in ranks) - 1) < 1e-9
    kept = ml.meta_filter(table, model, COLS, 0.55).collect()
    assert {r.id for r in kept} == {r.id for r in table.where("y = 1").collect()} and all(r.p >= 0.55 for r in kept)
    train = table.where("substring(k, 2) % 3 > 0")
    fresh = ml.validate_oos(train, table, "k", COLS, "mult", **HOW).collect()
    assert {r.k for r in fresh} == {f"k{i}" for i in range(0, 30, 3)} and all(abs(r.pred - r.mult) < 0.2 for r in fresh)


def test_strata_are_dealt_evenly(table):
    counts = ml.stratified_folds(table.drop("fold"), "id", "cls", 4).groupBy("cls", "fold").count().collect()
    for c in (0, 1, 2):
        own = [r["count"] for r in counts if r.cls == c]
        assert len(own) == 4 and max(own) - min(own) <= 1


def points(spark):
    p = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    names = [f"x{i}" for i in range(64)]
    rows = p.orderBy("vec_id").select(*names).collect()
    return p, names, np.array([list(r) for r in rows])


def test_kmeans_centroids_are_the_means_of_their_members(spark):
    p, names, x = points(spark)
    found, centroids = cluster.fit_kmeans(p, names, 6, 7, "x0")
    label = np.array([r.cluster for r in found.orderBy("vec_id").select("cluster").collect()])
    centre = {r.cluster: np.array(r.centroid) for r in centroids.collect()}
    means = np.array([x[label == c].mean(axis=0) for c in range(6)])
    assert sorted(centre) == list(range(6)) and np.median(x[:, 0][label == 0]) <= np.median(x[:, 0][label == 5])
    assert all(np.allclose(centre[c], means[c], atol=0.05) for c in range(6))  # the last step of the fit moves few members
    far = ((x[:, None] - np.array([centre[c] for c in range(6)])[None]) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == label).all()


def test_pca_is_the_eigen_decomposition(spark):
    p, names, x = points(spark)
    found, model = cluster.fit_pca(p, names, 5)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    axes = model.pc.toArray()
    assert np.allclose(axes.T @ axes, np.eye(5), atol=1e-9) and np.allclose(np.abs((axes * vectors[:, ::-1][:, :5]).sum(axis=0)), 1, atol=1e-6)
    assert np.allclose(model.explainedVariance.toArray(), values[::-1][:5] / values.sum(), atol=1e-9)
    assert np.allclose(np.array([r.pc for r in found.orderBy("vec_id").select("pc").collect()]), x @ axes, atol=1e-6)


def trend(x, rounds=5):
    """Local linear trend by the textbook filter, noise re-estimated from residuals."""
    f, h = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]])
    r = max(np.var(np.diff(x)) / 2, 1e-9)
    q = np.diag([r / 10, r / 100])
    for _ in range(rounds):
        m, p, ms, innovations, moves = np.array([x[0], 0.0]), np.eye(2) * r * 10, [], [], []
        for z in x:
            m, p = f @ m, f @ p @ f.T + q
            gain = p @ h.T / (h @ p @ h.T + r)
            innovations.append(z - m[0])
            moves.append(gain[:, 0] * innovations[-1])
            m, p = m + moves[-1], (np.eye(2) - gain @ h) @ p
            ms.append(m)
        ms, moves = np.array(ms), np.array(moves)
        r = max(float(np.mean(np.array(innovations)[1:] * (x - ms[:, 0])[1:])), 1e-9)
        q = np.diag(np.maximum(np.mean(moves[1:] ** 2, axis=0), 1e-12))
    return ms[:, 0], ms[:, 1]


def test_momentum_signals_step_by_step(spark):
    r = np.random.default_rng(12)
    v = 1000 * np.exp(r.normal(0, 0.05, 120).cumsum())
    v[60] *= 9
    df = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(hours=i), i, float(x)) for i, x in enumerate(v)], "k string, ts timestamp, i long, v double").repartition(3)
    got = sorted(kernels.momentum_signals(df, "k", ["ts"], "v", "i", 1.0, 0.1).collect(), key=lambda g: g.i)
    returns = np.concatenate([[0.0], np.diff(np.log(v))])
    level, slope = trend(np.clip(returns, returns.mean() - 5 * returns.std(), returns.mean() + 5 * returns.std()))
    assert np.allclose([g.level for g in got], level, atol=1e-9) and np.allclose([g.slope for g in got], slope, atol=1e-9)
    assert [g.entry for g in got] == [bool(i and level[i] > 0 >= level[i - 1]) for i in range(120)] and any(g.entry for g in got)
    assert [g.exit for g in got] == dsp.cusum(level, 1.0, 0.1)[2].tolist()


def test_approximate_neighbours_on_the_larger_table(spark):
    from sparkseries.queries import load_all

    q, d = load_all()[0], "/root/testdata/sf0.1"
    near, found = ({(r.query, r.neighbour) for r in q[n](spark, d).collect()} for n in ("tk1_knn", "tk9_approx_knn"))
    assert near and len(near & found) >= 0.9 * len(near)


def test_workloads_over_models(spark):
    """Grades follow the predictions; candidates come from the chosen groups, best first."""
    from sparkseries.queries import load_all

    q = load_all()[0]
    grades = {r.grade: r for r in q["w1_early_warning"](spark, SF).collect()}
    total = sum(r.n for r in grades.values())
    assert set(grades) <= set("SABCD") and grades["S"].n <= 0.05 * total and all(r.mean_multiple > 0 for r in grades.values())
    found = q["w3_lifecycle_candidates"](spark, SF).collect()
    assert 0 < len(found) <= 50 and [r.composite for r in found] == sorted((r.composite for r in found), reverse=True) and all(r.cluster >= 2 for r in found if "cluster" in r)


@pytest.mark.parametrize("how", ["forward", "binary"])
def test_folds_read_their_rows_once(spark, how):
    """Rows are computed for all folds together (a checkpoint takes two passes), not for each fit and each level of its trees."""
    from sparkseries.operators import ml

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(300).selectExpr("id", "CAST(id % 3 AS int) AS fold", "CAST(id % 7 AS double) AS a", "CAST(id % 5 AS double) AS b", "1.0 + id % 4 AS m", "CAST(id % 2 AS int) AS y")
    df = df.mapInArrow(counted, df.schema)
    out = ml.train_forward_multiple(df, ["a"], ["b"], "m", folds=3, trees=2, depth=2) if how == "forward" else ml.train_binary(df, ["a", "b"], "y", folds=3, trees=2, depth=2)
    assert out.count() == 300 and 300 <= seen.value <= 600


def test_funnel_reads_its_bars_for_training_and_for_trades_only(spark):
    """The statistics do not compute the scored trades again."""
    from sparkseries.plans import workloads

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    bars = spark.range(800).selectExpr("id DIV 40 AS k", "id", "id % 40 AS i", "timestamp_seconds(id) AS ts", "30 + 25 * sin(0.9 * (id % 40) + id DIV 40) AS v", "1.0 + id % 7 AS vol", "0L AS h")
    out = workloads.funnel(bars.mapInArrow(counted, bars.schema), "k", ["ts", "id"], "v", "vol", "h", "i", 10, 0.2, 0.5, trees=2, depth=2).collect()
    assert len(out) == 1 and out[0].n > 20 and seen.value == 2 * 800


def test_funnel_trades_of_many_keys(spark):
    """The trades of each key by itself: with a null key, keys of one row, keys without a trade and rows in no order."""
    from sparkseries.kernels import trades

    r = np.random.default_rng(5)
    series = {k: (r.uniform(5, 100, n), r.random(n) < p, r.random(n), r.choice(["HOLD", "SL_25"], n)) for k, n, p in [(None, 70, 0.4), (1, 1, 1.0), (2, 90, 0.0), (3, 130, 0.5), (4, 1, 0.0), (5, 60, 0.2)]}
    rows = [(k, i, float(v), bool(c), float(s), str(a)) for k, cols in series.items() for i, (v, c, s, a) in enumerate(zip(*cols))]
    df = spark.createDataFrame([rows[j] for j in r.permutation(len(rows))], "k int, i int, v double, c boolean, s double, a string").repartition(3)
    got = sorted(kernels.simulate_funnel(df, "k", ["i"], "v", "c", "s", "a", 0.5).collect(), key=lambda x: (x.k or 0, x.entry_idx))
    wanted = [(k, t["entry_idx"], t["ret"], t["held"], t["best"]) for k, (v, c, s, a) in series.items() for t in trades.funnel(v, c, s, list(a), 0.5)]
    assert len({k for k, *_ in wanted}) >= 3 and [tuple(x) for x in got] == wanted
    assert kernels.simulate_funnel(df.where("k IN (2, 4)"), "k", ["i"], "v", "c", "s", "a", 0.5).collect() == []


def test_kernel_on_many_keys_returns_any_number_of_rows(spark):
    """Rows come back under their own key, over calls of about 40 rows (one key is longer than that)."""
    df = spark.range(400).selectExpr("IF(id < 300, id DIV 20, 99) AS k", "id")
    odd = lambda keys: [{"x": a["id"][a["id"] % 20 < a["id"][0] // 20] for _ in "x"} for a in keys]
    got = sorted(tuple(x) for x in kernels.many_keys(df, "k", ["id"], ["id"], odd, "x bigint", rows=40).collect())
    assert got == [(i // 20, i) for i in range(300) if i % 20 < i // 20] + [(99, i) for i in range(300, 400) if i % 20 < 15]
