"""Recurrences in segments equal those of the whole series."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.kernels import dsp, paths, regimes
from sparkseries.operators import hidden, scans

T0 = datetime(2024, 1, 1)


def whole(x):
    line, trigger = dsp.itrend(x)
    fish, signal = dsp.fisher(x)
    return {"ema_13": dsp.ema(x, 13), **dsp.macd(x), "roofing": dsp.roofing(x), "fisher": fish, "fisher_signal": signal, "ebsw": dsp.sinewave(x), "itrend": line, "itrend_trigger": trigger, "above_itrend": (x > line).astype(int), "hurst": dsp.rolling_hurst(x)}


@pytest.fixture(scope="module")
def series(spark):
    """A hot key with gaps and bursts, a constant one, keys of one to three rows, a null key."""
    r = np.random.default_rng(7)
    out = {"hot": 100 * np.exp(r.normal(0, 0.03, 1500).cumsum()), "flat": np.full(130, 5.0), "one": np.array([3.0]), "two": np.array([3.0, 4.0]), "three": np.array([9.0, 1.0, 2.0]), None: 50 + r.normal(size=200).cumsum()}
    rows = []
    for k, x in out.items():
        at = np.cumsum(r.choice([1, 2, 60, 3000], len(x), p=[0.6, 0.3, 0.09, 0.01]))
        rows += [(k, T0 + timedelta(seconds=int(t)), i, float(v)) for i, (t, v) in enumerate(zip(at, x))]
    r.shuffle(rows)
    return out, spark.createDataFrame([(k, t, int(i), v) for k, t, i, v in rows], "k string, ts timestamp, i long, v double")


def by_key(df):
    found = {}
    for row in df.collect():
        found.setdefault(row.k, []).append(row)
    return {k: sorted(rows, key=lambda r: r.i) for k, rows in found.items()}


@pytest.mark.parametrize("rows", [30, 100_000])
def test_indicators(spark, series, rows):
    values, df = series
    parts = scans.packed(df, "k", ["ts"], ["v", "i"], rows).groupBy("k").agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()
    assert {p.k: p.c for p in parts}["hot"] == 1 if rows > 1000 else max(p.c for p in parts) > 20 and min(p.least for p in parts if p.k == "hot") < 5
    found = by_key(scans.indicators(df, "k", ["ts"], "v", "i", rows))
    assert {k: len(x) for k, x in found.items()} == {k: len(x) for k, x in values.items()}
    for k, x in values.items():
        for name, want in whole(x).items():
            got = np.array([np.nan if r[name] is None else r[name] for r in found[k]], float)
            even = np.abs(x - dsp.itrend(x)[0]) < 1e-9 if name == "above_itrend" else np.zeros(len(x), bool)  # a tie but for rounding
            assert np.allclose(got[~even], want[~even], rtol=1e-9, atol=1e-9, equal_nan=True), (k, name)


def test_averages_hold_over_missing_values(spark):
    r = np.random.default_rng(2)
    x = np.where(r.random(400) < 0.3, np.nan, r.normal(size=400).cumsum())
    x[:40], x[200:290] = np.nan, np.nan  # segments without a value, at the start and inside
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=i), i, float(v)) for i, v in enumerate(x)], "k string, ts timestamp, i long, v double")
    found = by_key(scans.indicators(df, "k", ["ts"], "v", "i", 25))["a"]
    for name, want in {"ema_13": dsp.ema(x, 13), **dsp.macd(x)}.items():
        assert np.allclose(np.array([np.nan if row[name] is None else row[name] for row in found], float), want, atol=1e-9, equal_nan=True), name


@pytest.mark.parametrize("h,drift", [(0.5, 0.0), (1.0, 0.1), (4.0, 0.02), (0.0, 0.3)])
def test_cusum(spark, series, h, drift):
    values, df = series
    centred = df.withColumn("v", F.col("v") - 60)
    found = by_key(scans.cusum(centred, "k", ["ts"], "v", "i", h, drift, 30))
    for k, x in values.items():
        up, down, alarm = dsp.cusum(x - 60, h, drift)
        assert np.allclose([r.up for r in found[k]], up, atol=1e-6) and np.allclose([r.down for r in found[k]], down, atol=1e-6) and [r.alarm for r in found[k]] == alarm.tolist(), k


def test_pieces_of_sums_by_trying_every_start():
    r = np.random.default_rng(4)
    for _ in range(50):
        limit, gains = float(r.uniform(0.5, 3)), np.round(r.normal(0, 1, 40), 1)
        step = scans.Sums("x", lambda s, g=gains, m=limit: (g, m))
        pieces = np.array(step.reduce(None))
        assert len(pieces) < 60
        for u in r.uniform(0, limit, 40):
            s = scans.Segment({}, {}, 0, {"x": np.array([u])})
            assert abs(step.apply(np.array([u]), pieces)[0] - step.run(s)[0][-1]) < 1e-9


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, i long, v double")
    assert scans.indicators(df, "k", ["ts"], "v", "i").count() == 0 and scans.cusum(df, "k", ["ts"], "v", "i").count() == 0


@pytest.mark.parametrize("rows", [20, 100_000])
def test_signatures(spark, rows):
    r = np.random.default_rng(3)
    walks = {k: np.stack([r.normal(size=n).cumsum(), np.arange(n) % 7], axis=1) for k, n in (("long", 300), ("one", 1), ("two", 2), ("five", 5))}
    at = {k: np.cumsum(r.choice([1, 500], len(x), p=[0.95, 0.05])) for k, x in walks.items()}
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=int(t)), float(a), float(b)) for k, x in walks.items() for t, (a, b) in zip(at[k], x)], "k string, ts timestamp, a double, b double")
    got = {g.k: np.array(g.sig) for g in scans.signatures(df, "k", ["ts"], ["a", "b"], rows).collect()}
    for k, x in walks.items():
        assert np.allclose(got[k], paths.signature(np.column_stack([np.linspace(0, 1, len(x)), x])), rtol=1e-8, atol=1e-8), k
    for scale in ("prefix", "full"):
        found = {(g.k, g.len): np.array(g.sig) for g in scans.prefix_signatures(df, "k", ["ts"], ["a", "b"], 3, scale, rows).collect()}
        want = {(k, n): s for k, x in walks.items() for n, s in paths.prefix_signatures(x, 3, scale)}
        assert found.keys() == want.keys() and all(np.allclose(found[key], want[key], rtol=1e-8, atol=1e-7) for key in want)


def test_chen_product_is_the_signature_of_the_joined_path():
    x = np.random.default_rng(1).normal(size=(9, 3))
    assert np.allclose(scans.chen(paths.signature(x[:5]), paths.signature(x[4:]), 3), paths.signature(x))


@pytest.mark.parametrize("rows", [25, 100_000])
def test_pooled_model_in_segments(spark, rows):
    """Posteriors, the sums of EM rounds and the likelihood equal those of whole series."""
    r = np.random.default_rng(11)
    x = {k: np.where(r.random((n, 1)) < 0.5, 0.0, 1.0) * [2.0, -1.0] + r.normal(size=(n, 2)) for k, n in (("long", 400), ("two", 2), ("mid", 60), ("one", 1))}
    at = {k: np.cumsum(r.choice([1, 700], len(v), p=[0.95, 0.05])) for k, v in x.items()}
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=int(t)), i, float(a), float(b)) for k, v in x.items() for i, (t, (a, b)) in enumerate(zip(at[k], v))], "k string, ts timestamp, i long, a double, b double")
    model = hidden.fit_pooled_hmm(df, "k", ["ts"], ["a", "b"], rounds=3, rows=rows)
    want = regimes.start_model(np.concatenate([x[k] for k in sorted(x)]), 2)
    for _ in range(3):
        parts = [regimes.expect(v, want) for v in x.values() if len(v) > 1]
        want = regimes.maximise({n: sum(p[n] for p in parts) for n in parts[0]}) | {"ll": float(sum(p["ll"][0] for p in parts))}
    assert all(np.allclose(model[n], want[n], rtol=1e-8, atol=1e-8) for n in want)
    state = int(np.argmax(want["mean"][:, 0]))
    smooth = by_key(hidden.hmm_posterior(df, "k", ["ts"], ["a", "b"], "i", want, rows))
    for k, v in x.items():
        post = regimes.forward_backward(regimes.log_density(v, want["mean"], want["cov"]), want["start"], want["move"])[0]
        assert np.allclose([g.growth for g in smooth[k]], post[:, state], atol=1e-8), k


@pytest.mark.parametrize("n", [1, 2, 5, 67])
def test_products_of_many_rows_at_once(n):
    """Running products by doubling are those taken row by row, up to their scale."""
    m = np.random.default_rng(n).random((n, 3, 3))
    product, got = np.eye(3), hidden._running(m)
    for i in range(n):
        product = product @ m[i]
        assert np.allclose(got[i], product / product.sum())
