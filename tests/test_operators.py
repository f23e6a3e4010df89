"""Edge cases of operators: ties, gaps, nulls, empty tables, window edges."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkseries.functions.windows import Series
from sparkseries.operators import clean, features, joins, kernels, ml, stats, topk

T0 = datetime(2024, 1, 1)


def series(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(hours=h), v) for k, h, v in rows], "k string, ts timestamp, v double")


def test_crossing_and_first_peak(spark):
    df = series(spark, [("a", 0, 1.0), ("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 9.0), ("b", 0, 1.0), ("c", 0, 7.0)])
    got = clean.trim_to_peak(clean.trim_from_crossing(df, "k", "ts", "v", 5.0), "k", "ts", "v")
    assert sorted((r.k, r.ts.hour) for r in got.collect()) == [("a", 1), ("a", 2), ("c", 0)]


def test_window_edges_are_closed(spark):
    df = series(spark, [("a", h, float(h)) for h in range(0, 80)])
    keys = joins.origins(df, "k", "ts")
    n = {r.win: r.n for r in joins.sliding_windows(df, keys, "k", "ts").groupBy("win").agg(F.count("*").alias("n")).collect()}
    assert set(n.values()) == {25} and max(n) == (79 - 24) // 6
    f = {r.win: (r.a, r.b) for r in joins.future_windows(df, keys, "k", "ts", 24, 6, 48).groupBy("win").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    assert f[0] == (25.0, 72.0)


def test_asof_ties_strict_and_nulls(spark):
    left = series(spark, [("a", 1, 0.0), ("a", 3, 0.0), (None, 3, 0.0)]).select("k", "ts")
    right = series(spark, [("a", 1, 1.0), ("a", 1, 2.0), (None, 1, 5.0)])
    got = lambda **how: sorted((r.k or "", r.ts.hour, r.v) for r in joins.asof_join(left, right, "k", "ts", ["v"], **how).collect())
    assert got() == [("", 3, None), ("a", 1, 2.0), ("a", 3, 2.0)]
    assert got(strict=True)[1] == ("a", 1, None)
    assert got(tolerance=3600)[2] == ("a", 3, None)
    assert got(direction="forward")[1:] == [("a", 1, 2.0), ("a", 3, None)]


def test_constant_series_and_empty_tables(spark):
    df = series(spark, [("a", h, 2.0) for h in range(4)])
    assert {r.v_rz for r in clean.robust_z(df, "k", ["v"]).collect()} == {0.0}
    assert {r.v_mm for r in clean.minmax(df, "k", ["v"]).collect()} == {0.0}
    empty = df.limit(0)
    assert clean.lifecycle_window(empty, "k", "ts", "v", 1.0).count() == 0
    assert joins.sliding_windows(empty, joins.origins(empty, "k", "ts"), "k", "ts").count() == 0
    assert stats.kaplan_meier(spark.createDataFrame([], "duration int, observed boolean")).count() == 0


def test_kaplan_meier_without_censoring_is_the_ecdf(spark):
    d = [1, 2, 2, 5]
    got = {r.duration: r.survival for r in stats.kaplan_meier(spark.createDataFrame([(x, True) for x in d], "duration int, observed boolean")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {1: 0.75, 2: 0.25, 5: 0.0}


def test_folds_hold_out_whole_keys(spark):
    df = spark.createDataFrame([(i % 23, i) for i in range(200)], "k int, x int")
    for folded in (ml.group_folds(df, "k", 5), ml.hashed_folds(df, "k", 5)):
        assert folded.groupBy("k").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_knn_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    got = {(g.query, g.rank): g.neighbour for g in topk.knn(df.where("id < 5"), df, "id", "x", 3).collect()}
    for q in range(5):
        order = [i for i in np.argsort(((x - x[q]) ** 2).sum(axis=1)) if i != q][:3]
        assert [got[q, k + 1] for k in range(3)] == order


def test_pairwise_covers_all_pairs_in_blocks(spark):
    df = spark.createDataFrame([(i, [[float(i)], [float(i + 1)]]) for i in range(20)], "k int, path array<array<double>>")
    got = kernels.pairwise(df, "k", "path", block=6).collect()
    assert len(got) == 190 and len({(g.a, g.b) for g in got}) == 190 and all(g.a < g.b for g in got)


def test_episodes_censor_the_open_run(spark):
    df = series(spark, [("a", h, v) for h, v in enumerate([1.0, 1.0, 2.0, 3.0, 4.0, 5.0])]).withColumn("roc", Series("k", "ts").roc("v", 1, percent=True))
    got = kernels.episodes(df, "k", ["ts"], "v", "roc", min_bars=1).collect()
    assert [(g.entry_idx, g.exit_idx, g.observed) for g in got] == [(2, 5, False)]


def test_cox_sign_and_stationarity(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=400)
    t = np.ceil(r.exponential(1, 400) * np.exp(-x) * 20)
    fit = kernels.cox_ph(spark.createDataFrame([(float(a), True, float(b)) for a, b in zip(t, x)], "t double, o boolean, x double"), "t", "o", ["x"], rounds=12)
    assert 0.7 < fit["coef"]["x"] < 1.3 and fit["gradient"] < 1e-3


def test_streamed_positions_equal_batch(spark):
    from sparkseries.kernels import trades as R
    from sparkseries.queries.streams import ss8_stream_positions
    from sparkseries.queries.views import bars_u

    d = "/root/testdata/sf0.001"
    c = [R.trailing(40.0), ("hard_stop", lambda p: p.gain < -80.0), ("time_stop", lambda p: p.bars >= 12)]
    b = bars_u(spark, d).withColumn("signal", F.col("vol") > 70)
    batch = kernels.simulate(b, "k", ["ts", "id"], ["v", "signal"], lambda a: R.positions(a["v"], a["signal"], c)).where("exit_reason <> 'end_of_data'")
    got = ss8_stream_positions(spark, d)
    key = lambda df: sorted((r.k, r.entry_idx, r.exit_idx, r.exit_reason) for r in df.collect())
    assert key(batch) == key(got)


def test_streams_carry_state_over_micro_batches(spark, tmp_path):
    """Input in several files, one in each micro-batch: positions, partial sales and gates equal those of one batch."""
    from sparkseries.queries.streams import ORDER, stated
    from sparkseries.streaming import state as S

    d = "/root/testdata/sf0.001"
    from sparkseries.queries.views import ticks

    act = F.when(F.col("kind") == "error", "SL_50").when(F.col("kind") == "purchase", "TP_25").otherwise("HOLD")
    t = ticks(spark, d).select("k", "ts", "id", "v", (F.col("vol") > 70).alias("signal"), act.alias("action"), (F.col("vol") / 50).alias("roc"))
    cuts = [r[0] for r in t.selectExpr("percentile(unix_micros(ts), array(0.2, 0.5, 0.8))").collect()][0]
    part = sum((F.unix_micros("ts") > c).cast("int") for c in cuts)
    for i in range(4):
        t.where(part == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/cut")
    t.coalesce(1).write.parquet(f"file://{tmp_path}/whole")
    jobs = [(S.Positions, {"v": "v", "signal": "signal", "stop": 40.0, "max_bars": 12}), (S.PartialPositions, {"v": "v", "signal": "signal", "action": "action", "max_bars": 12, "fractions": {"SL_50": 0.5, "TP_25": 0.25, "EXIT": 1.0}}),
            (S.Episodes, {"v": "v", "roc": "roc", "min_roc": 1.0, "max_fall": 60.0, "min_bars": 2})]
    for kind, how in jobs:
        found = []
        for name in ("cut", "whole"):
            stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")
            found.append(sorted(tuple(r) for r in stated(S.stream_state(stream, "k", ORDER, kind, **how), "cut").collect()))
        assert found[0] == found[1] and found[0]


def test_global_ranks_in_ranges(spark):
    from sparkseries.operators import ml as M
    from sparkseries.operators import stats as A
    from sparkseries.operators import topk as T

    r = np.random.default_rng(2)
    x = [None, None, *np.round(r.standard_normal(3000), 1).tolist(), float("inf"), -1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double")
    got = {g.i: g.rank for g in A.mean_rank(df.where("x is not null"), "x", "rank").collect()}
    want = pd.Series(x[2:]).rank()
    assert got == {i + 2: w for i, w in enumerate(want)}
    best = {g.i: g["rank"] for g in T.best_rank(df.withColumn("ts", F.timestamp_seconds("i")), "i", "x", "ts").collect()}
    assert best == {i: int(w) for i, w in enumerate(pd.Series(x).rank(method="min", ascending=False, na_option="bottom"))}
    folds = [g.fold for g in M.group_folds(df.select("i"), "i", 7).collect()]
    assert len(folds) == len(x) and max(folds.count(f) for f in range(7)) - min(folds.count(f) for f in range(7)) <= 1


def test_lsh_recall(spark):
    from sparkseries.queries import load_all

    q, d = load_all()[0], "/root/testdata/sf0.001"
    near = {(r.query, r.neighbour) for r in q["tk1_knn"](spark, d).collect()}
    found = {(r.query, r.neighbour) for r in q["tk9_approx_knn"](spark, d).collect()}
    assert near and len(near & found) >= 0.9 * len(near)


def test_pairwise_queries_take_all_users(spark):
    from sparkseries.kernels import paths
    from sparkseries.queries import load_all
    from sparkseries.queries.kernels import short_paths

    q, d = load_all()[0], "/root/testdata/sf0.01"
    p = {r.k: np.array(r.path, float) for r in short_paths(spark, d).collect()}
    users = {r.user_id for r in spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().collect()}
    got = {(r.a, r.b): r.distance for r in q["h13_dtw_pairs"](spark, d).collect()}
    assert set(p) == users and len(users) > 40 and got.keys() == {(a, b) for a in users for b in users if a < b}
    assert all(abs(got[a, b] - paths.dtw(p[a], p[b])) < 1e-5 for a, b in list(got)[::37])
    assert {r.k for r in q["jn17_pairwise"](spark, d).collect()} == users


def test_queries_over_whole_tables(spark):
    """Prefixes of every length, every entry, every component."""
    from sparkseries.kernels import paths
    from sparkseries.queries import load_all
    from sparkseries.queries.kernels import O, bars_u

    q, d = load_all()[0], "/root/testdata/sf0.001"
    bars = {}
    for r in bars_u(spark, d).orderBy("k", *O).collect():
        bars.setdefault(r.k, []).append(r)
    got = {(r.k, r.len): r.energy for r in q["h12_prefix_signatures"](spark, d).collect()}
    assert got.keys() == {(k, n) for k, b in bars.items() for n in range(3, len(b) + 1)} and max(n for _, n in got) > 12
    for k, b in bars.items():
        p = np.array([(r.v / 100, r.h) for r in b])
        for n in range(3, len(b) + 1, 7):
            assert np.isclose(got[k, n], (paths.signature(np.column_stack([np.linspace(0, 1, n), p[:n]])) ** 2).sum(), rtol=1e-6, atol=1e-5)
    entries = {f"{k}:{r.i}" for k, b in bars.items() for r in b if r.v >= 60}
    assert entries and {r.entry_id for r in q["h23_label_actions"](spark, d).select("entry_id").collect()} == entries
    assert {r.entry_id for r in q["h25_replay_actions"](spark, d).select("entry_id").collect()} == entries


def test_models_read_all_components(spark):
    from sparkseries.queries import models

    rows = [(i, [0.0] * 20 + [5.0 * (i % 6) + i / 1000] + [0.0] * 43, 0) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{(d := _tmp())}/embeddings.parquet")
    clusters = {(r.vec_id % 6, r.cluster) for r in models.ml2_kmeans(spark, d).collect()}
    assert len({c for _, c in clusters}) > 1
    assert len({round(r.pc[0], 1) for r in models.ml6_pca(spark, d).collect()}) > 1


def _tmp():
    import tempfile

    return tempfile.mkdtemp(prefix="spark-")


def test_stream_keys_do_not_share_state(spark, tmp_path):
    """Two portfolios in one partition: each has its own open positions, so neither is full because of the other."""
    from sparkseries.queries.streams import ORDER, stated
    from sparkseries.streaming import state as S

    rows = [(p, T0 + timedelta(minutes=i), i, f"{p}{i}", "open", 0.0) for p in (1, 2, 3) for i in range(3)]
    df = spark.createDataFrame(rows, "p long, ts timestamp, id long, token string, kind string, pnl double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    got = stated(S.stream_state(stream, "p", ORDER, S.RiskGate, token="token", capital=1000.0, size=100.0, max_open=2, max_loss=80.0, max_trades=6, window=5, min_win_rate=0.2, cooldown=60.0), "gate")
    assert sorted((r.p, r.token, r.ok) for r in got.collect()) == [(p, f"{p}{i}", i < 2) for p in (1, 2, 3) for i in range(3)]


def test_exact_percentiles_by_group(spark):
    r = np.random.default_rng(5)
    rows = [(None if g == 0 else f"g{g}", None if i % 50 == 7 else float(x)) for g, n in ((0, 40), (1, 2000), (2, 1), (3, 6)) for i, x in enumerate(np.round(r.normal(size=n), 2))]
    df = spark.createDataFrame([*rows, ("none", None)], "g string, x double")
    got = {q.g: (q.a, q.b, q.c) for q in stats.exact_percentiles(df, "x", {"a": 0.25, "b": 0.5, "c": 1.0}, ("g",)).collect()}
    want = pd.DataFrame(rows, columns=["g", "x"]).dropna(subset="x").groupby("g", dropna=False)["x"]
    assert len(got) == 4 and "none" not in got
    for g, x in want:
        assert np.allclose(got[g if isinstance(g, str) else None], np.quantile(x, [0.25, 0.5, 1.0]))
    assert tuple(stats.thresholds(df.limit(0), "x", (0.5,)).first()) == (None,)
    alive = stats.envelope(df.withColumn("s", F.lit(1)), "g", "s", "x").collect()
    assert {a.g: (a.median, a.alive) for a in alive}["none"] == (None, 1) and len(alive) == 5


def test_survival_at_is_the_last_step(spark):
    curve = spark.createDataFrame([(float(t), 1 / (t + 1), t / 100) for t in range(1, 400, 3)], "duration double, survival double, hazard double")
    asked = [None, -1.0, 0.5, 1.0, 3.9, 4.0, 4.0, 250.25, 1e9]
    got = {r.i: (r.survival, r.hazard) for r in stats.survival_at(curve, spark.createDataFrame(list(enumerate(asked)), "i long, age double"), "age").collect()}
    for i, a in enumerate(asked):
        step = [t for t in range(1, 400, 3) if a is not None and t <= a]
        assert got[i] == ((1 / (step[-1] + 1), step[-1] / 100) if step else (1.0, 0.0))
    assert stats.survival_at(curve.limit(0), spark.createDataFrame([(1.0,)], "age double"), "age").first().survival == 1.0


def test_knn_blocks_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_LOT", 7)
    monkeypatch.setattr(topk, "CORPUS_BLOCK", 11)
    r = np.random.default_rng(6)
    rows = [(i, i % 4, [float(x) for x in r.integers(-2, 3, 3)]) for i in range(60)]
    odd = [(100, 0, None), (101, 1, []), (102, 2, [1.0, None, 0.0]), (103, 3, [float("nan"), 0.0, 0.0]), (104, 1, [0.0, 1.0]), (105, 1, [0.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "id long, e long, x array<double>")
    for entity in (None, "e"):
        got: dict = {}
        for g in topk.knn(df, df, "id", "x", 5, entity).collect():
            got.setdefault(g["query"], []).append((g["rank"], g.neighbour, round(g.distance, 9)))
        for i, _, x in rows:
            far = sorted((math.dist(x, y), j, e) for j, e, y in rows if j != i)
            kept, seen = [], set()
            for f, j, e in far:
                if entity is None or e not in seen:
                    kept.append((j, round(f, 9)))
                    seen.add(e)
            assert sorted(got[i]) == [(n + 1, *x) for n, x in enumerate(kept[:5])]
        assert set(got) == {i for i, *_ in rows} | {104, 105} and got[104] == [(1, 105, 1.0)]
    assert topk.knn(df.limit(0), df, "id", "x", 3).count() == topk.knn(df, df.limit(0), "id", "x", 3).count() == 0
    found = topk.prefix_knn(df.where("id < 60"), df.where("id < 60"), "id", "e", "x", 3).collect()
    assert len(found) == 180 and all(g["query"] % 4 == g.neighbour % 4 for g in found)


def test_cox_maximises_the_partial_likelihood(spark):
    """The gradient of the penalised log partial likelihood, summed over risk sets row by row, is 0 at the fit."""
    r = np.random.default_rng(8)
    t, o, x = np.ceil(r.exponential(8, 120)), r.random(120) < 0.7, r.normal(size=(120, 2))
    rows = [(float(a), bool(b), float(c), float(e)) for a, b, (c, e) in zip(t, o, x)]
    fit = kernels.cox_ph(spark.createDataFrame(rows, "t double, o boolean, x double, y double"), "t", "o", ["x", "y"], rounds=15)
    z, beta = (x - x.mean(axis=0)) / x.std(axis=0), np.array([fit["coef"]["x"], fit["coef"]["y"]]) * x.std(axis=0)
    pull = -0.1 * beta
    for i in np.flatnonzero(o):
        risk = np.exp(z[t >= t[i]] @ beta)
        pull = pull + z[i] - risk @ z[t >= t[i]] / risk.sum()
    assert np.abs(pull).max() < 1e-6


def test_old_snapshots_go(spark, tmp_path):
    from sparkseries.streaming import windows as W

    df = spark.createDataFrame([(i % 3, T0 + timedelta(hours=i), float(i)) for i in range(8)], "k long, ts timestamp, v double")
    for i in range(4):
        df.where((F.col("v") / 2).cast("int") == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    W.stream_upsert(stream, f"file://{tmp_path}/table", f"file://{tmp_path}/log", ["k"], "ts").awaitTermination()
    assert len(W.snapshots(spark, f"file://{tmp_path}/table")[1]) == 2
    assert {(r.k, r.v) for r in W.latest(spark, f"file://{tmp_path}/table").collect()} == {(0, 6.0), (1, 7.0), (2, 5.0)}


def test_trades_from_a_value_of_zero():
    v = np.array([1.0, 0.0, 5.0, 9.0, 2.0, 0.0])
    enter = np.array([False, True, False, False, False, True])
    got = R_positions(v, enter, 40.0)
    assert [(t["entry_idx"], t["exit_idx"], t["return_pct"], t["peak_return_pct"]) for t in got] == [(1, 4, math.inf, math.inf), (5, 5, 0.0, 0.0)]
    flat = R_positions(np.zeros(3), np.array([True, False, False]), 40.0)
    assert len(flat) == 1 and math.isnan(flat[0]["return_pct"])


def R_positions(v, enter, stop):
    from sparkseries.kernels import trades as R

    return R.positions(v, enter, [R.trailing(stop)])


def test_forward_return_from_zero_is_the_upper_bound(spark):
    df = series(spark, [("a", h, v) for h, v in enumerate([0.0, 4.0, 1.0, 0.0, 0.0])])
    s = Series("k", "ts")
    got = [r.f for r in df.select("ts", s.forward_return("v", 1, -1.0, 10.0).alias("f")).orderBy("ts").collect()]
    assert got == [10.0, -0.75, -1.0, 10.0, None]


def test_doubles_round_as_the_sql_side(spark):
    import duckdb

    from sparkseries.queries import rounded_double

    x = [8.0046875, 0.0000005, -0.0000005, 1.0000005, 2.5e15, -1e300, 1e305, math.inf, -0.0, *[i / 640 for i in range(-4000, 4000)], *np.random.default_rng(1).normal(size=2000).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = [r.y for r in df.select("i", rounded_double("x", 6).alias("y")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT list(round(CAST(u AS DOUBLE), 6) + 0.0 ORDER BY i) FROM (SELECT unnest(?) AS u, unnest(range(?)) AS i)", [x, len(x)]).fetchone()[0]][0]
    assert got == want


def test_streamed_positions_from_a_value_of_zero():
    from sparkseries.streaming.state import Positions

    p = Positions("k", ["ts"], v="v", signal="s", stop=40.0, max_bars=2)
    state = {"i": -1, "open": None}
    out = [r for v, s in [(0.0, True), (0.0, False), (3.0, False), (0.0, True), (0.0, False), (0.0, False)] for r in p.step(state, {"v": v, "s": s})]
    assert [(r["entry_idx"], r["exit_idx"], r["exit_reason"]) for r in out] == [(0, 2, "time_stop"), (3, 5, "time_stop")]
    assert out[0]["return_pct"] == math.inf and math.isnan(out[1]["return_pct"])


def test_zero_is_a_peak_while_nothing_is_higher(spark):
    df = series(spark, [("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 3.0), ("a", 3, 1.0), ("a", 4, 3.0), ("b", 0, -2.0), ("b", 1, -5.0)]).withColumns({"i": F.hour("ts"), "vol": F.lit(1.0)})
    got = features.funnel_features(df, Series("k", "ts"), "v", "vol", "i").orderBy("k", "i").collect()
    assert [r.since_peak for r in got] == [0, 0, 0, 1, 0, 0, 1] and got[0].drawdown is None
