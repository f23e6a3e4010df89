"""Kernels against independent brute force, closed forms and identities."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from sparkseries.kernels import dsp, paths, regimes, trades

rng = np.random.default_rng(3)


def test_ema_of_constant_and_by_hand():
    assert np.allclose(dsp.ema(np.full(9, 4.0), 5), 4)
    assert np.allclose(dsp.ema(np.array([1.0, 2, np.nan, 4]), 3), [1, 1.5, 1.5, 2.75])


def test_filters_ignore_constants_and_follow_lines():
    assert np.allclose(dsp.roofing(np.full(80, 7.0)), 0)
    line, trigger = dsp.itrend(np.full(60, 3.0))
    assert np.allclose(line, 3) and np.allclose(trigger, 3)
    assert np.all(np.abs(dsp.sinewave(rng.normal(size=200).cumsum())) <= 1)
    f, s = dsp.fisher(rng.normal(size=50))
    assert np.allclose(f[:-1], s[1:])


def test_hurst_orders_persistence():
    noise = rng.normal(size=600)
    assert dsp.hurst(np.zeros(10)) == 0.5
    assert dsp.hurst(noise.cumsum()) > dsp.hurst(noise) > dsp.hurst(np.diff(noise))


def test_cusum_resets():
    v = np.array([0.0, -1, -1, -1, 5, 5])
    up, down, alarm = dsp.cusum(v, 1.5 / v.std())  # the limit is 1.5
    assert alarm.tolist() == [False, False, True, False, False, False]
    assert down.tolist() == [0, -1, 0, -1, 0, 0] and up.tolist() == [0, 0, 0, 0, 0, 0]


def test_kalman_tracks_a_line():
    level, slope = regimes.kalman_trend(np.arange(100.0) * 2 + rng.normal(size=100) * 0.01)
    assert abs(slope[-1] - 2) < 0.1 and abs(level[-1] - 198) < 0.5


def test_kalman_pass_is_least_squares():
    """One pass of the filter: its last state is the generalised least-squares estimate of the whole model."""
    x = rng.normal(size=25).cumsum()
    r = max(np.var(np.diff(x)) / 2, 1e-9)
    rows, rhs = [], []
    n = len(x)

    def add(weight, entries, value):
        row = np.zeros(2 * n + 2)
        for at, c in entries:
            row[at] = c
        rows.append(row * weight)
        rhs.append(value * weight)

    prior = 1 / math.sqrt(r * 10)
    add(prior, [(0, 1)], x[0])
    add(prior, [(1, 1)], 0.0)
    for i in range(1, n + 1):
        add(1 / math.sqrt(r / 10), [(2 * i, 1), (2 * i - 2, -1), (2 * i - 1, -1)], 0.0)
        add(1 / math.sqrt(r / 100), [(2 * i + 1, 1), (2 * i - 1, -1)], 0.0)
        add(1 / math.sqrt(r), [(2 * i, 1)], x[i - 1])
    want = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0]
    level, slope = regimes.kalman_trend(x, 1)
    assert math.isclose(level[-1], want[-2], rel_tol=1e-6) and math.isclose(slope[-1], want[-1], rel_tol=1e-5, abs_tol=1e-8)


def test_viterbi_matches_enumeration():
    import itertools

    log_b, start, move = rng.normal(size=(6, 3)), np.array([0.2, 0.3, 0.5]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]])
    score = lambda p: math.log(start[p[0]]) + log_b[0, p[0]] + sum(math.log(move[a, b]) + log_b[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
    assert tuple(regimes.viterbi(log_b, start, move)) == max(itertools.product(range(3), repeat=6), key=score)


def test_em_step_maximises_the_weighted_likelihood():
    """New means and moves are the averages weighted by the posteriors, computed here row by row."""
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (30, 2))])
    m = regimes.start_model(x, 2)
    post = regimes.forward_backward(regimes.log_density(x, m["mean"], m["cov"]), m["start"], m["move"])[0]
    new = regimes.maximise(regimes.expect(x, m))
    for s in range(2):
        mean = sum(p * r for p, r in zip(post[:, s], x)) / post[:, s].sum()
        cov = sum(p * np.outer(r - mean, r - mean) for p, r in zip(post[:, s], x)) / post[:, s].sum()
        assert np.allclose(new["mean"][s], mean, atol=1e-6) and np.allclose(new["cov"][s], cov, atol=1e-4)
    assert np.allclose(new["move"].sum(axis=1), 1) and np.allclose(new["start"].sum(), 1)


def test_regime_trades_by_hand():
    v = np.array([10, 10, 10, 10, 10, 10, 10, 12, 14, 13, 12, 11, 10, 5, 5, 2.0])
    growth = np.array([0.9, 0.9, 0, 0, 0, 0, 0.9, 0.5, 0.5, 0.2, 0.9, 0.9, 0.9, 0.9, 0, 0.9])
    c = trades.RegimeConfig(enter_above=0.6, exit_below=0.4, stop=50.0, grace=3, min_age=5)
    got = [(t["entry_idx"], t["exit_idx"], t["exit_reason"]) for t in trades.regime_trades(v, growth, c)]
    # in at 6 (rows before 5 are too young), out at 9 after the grace; in again at 10, 13 is 58 % below the peak; in at 15, the last row
    assert got == [(6, 9, "regime_change"), (10, 13, "trailing_stop"), (15, 15, "end_of_data")]
    fall = trades.regime_trades(np.array([10, 10, 10, 4.0, 4, 0.5]), np.array([0, 0.9, 0, 0, 0, 0]), trades.RegimeConfig(0.6, 0.4, 45.0, 4, 0))
    assert [(t["entry_idx"], t["exit_idx"], t["exit_reason"]) for t in fall] == [(1, 5, "hard_stop")]  # all rules hold at 5, the last one names it


def test_forward_backward_matches_enumeration():
    import itertools

    log_b, start, move = rng.normal(size=(5, 2)), np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]])
    total, post = 0.0, np.zeros((5, 2))
    for path in itertools.product(range(2), repeat=5):
        p = start[path[0]] * math.exp(log_b[0, path[0]])
        for i in range(1, 5):
            p *= move[path[i - 1], path[i]] * math.exp(log_b[i, path[i]])
        total += p
        for i, s in enumerate(path):
            post[i, s] += p
    got, moves, ll = regimes.forward_backward(log_b, start, move)
    assert np.allclose(got, post / total) and math.isclose(ll, math.log(total)) and math.isclose(moves.sum(), 4)


def test_em_likelihood_rises():
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(3, 1, (60, 2))])
    m, seen = regimes.start_model(x, 2), []
    for _ in range(6):
        s = regimes.expect(x, m)
        seen.append(float(s["ll"][0]))
        m = regimes.maximise(s)
    assert all(b >= a - 0.5 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_signature_identities():
    p = rng.normal(size=(12, 3)).cumsum(axis=0)
    s = paths.signature(p)
    s1, s2, s3 = s[:3], s[3:12].reshape(3, 3), s[12:].reshape(3, 3, 3)
    assert np.allclose(s1, p[-1] - p[0])
    assert np.allclose(np.multiply.outer(s1, s1), s2 + s2.T)
    for i in range(3):
        for j in range(3):
            for k in range(3):
                assert math.isclose(s1[i] * s2[j, k], s3[i, j, k] + s3[j, i, k] + s3[j, k, i], rel_tol=1e-9, abs_tol=1e-9)
    assert np.allclose(dict(paths.prefix_signatures(p, 3))[12], paths.signature(np.column_stack([np.linspace(0, 1, 12), p])))


def test_dtw_brute_force_and_symmetry():
    def slow(a, b):
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    a, b = rng.normal(size=(7, 2)), rng.normal(size=(4, 2))
    assert math.isclose(paths.dtw(a, b), slow(a, b)) and math.isclose(paths.dtw(a, b), paths.dtw(b, a)) and paths.dtw(a, a) == 0
    assert np.allclose(paths.resample_arc(np.array([[0.0, 0], [0, 4]]), 5)[:, 1], range(5))
    assert np.allclose(paths.resample_arc(np.ones((3, 2)), 4), 1)


@pytest.mark.parametrize("seed", range(4))
def test_trades_never_overlap(seed):
    r = np.random.default_rng(seed)
    v = np.exp(r.normal(size=300).cumsum() * 0.1) * 100
    got = trades.positions(v, r.random(300) < 0.2, [trades.trailing(10, 2), trades.hard(15)])
    assert got and all(t["entry_idx"] < t["exit_idx"] or t["exit_reason"] == "end_of_data" for t in got)
    assert all(a["exit_idx"] < b["entry_idx"] for a, b in zip(got, got[1:]))
    assert all(t["peak_value"] >= t["entry_value"] for t in got)


def test_buy_hold_and_replay_closed_forms():
    v = np.array([100.0, 110, 90, 130])
    assert math.isclose(trades.buy_and_hold(v), 0.3)
    assert math.isclose(trades.replay(v, ["HOLD"] * 4)["ret"], 0.3)
    assert math.isclose(trades.replay(v, ["HOLD", "EXIT", "HOLD", "HOLD"])["ret"], 0.1)


def test_md5_bucket(spark):
    from sparkseries.functions.scalars import hash_bucket

    got = spark.createDataFrame([(k,) for k in ("a", "token", "")], "k string").select("k", hash_bucket("k").alias("b")).collect()
    assert all(r["b"] == int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 100 for r in got)


def test_regimes_of_many_series_at_once(spark):
    """Series of all lengths, fitted together, have the states of a fit of each by itself."""
    from sparkseries.operators import kernels as K

    r = np.random.default_rng(4)
    series = {k: np.round(np.exp(3 + np.cumsum(r.normal(0, 0.1 + 0.2 * (np.arange(n) // 15 % 2), n))), 3) for k, n in enumerate([1, 2, 19, 20, 21, 30, 33, 67, 68, 70, 200])}
    series[99] = np.full(40, 5.0)
    want = {}
    for k, v in series.items():
        x = np.diff(np.log(np.maximum(v, 1)), prepend=0.0)
        x[0] = 0.0
        one = regimes.hmm_regime(x)
        want |= {(k, i): (one["state"][i], one["duration"][i], one["p_down"][i]) for i in range(len(v))}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k int, i long, v double").repartition(5)
    got = {(g.k, g.i): (g.state, g.duration, g.p_down) for g in K.hmm_regime(df, "k", ["i"], "v", "i").collect()}
    assert got.keys() == want.keys()
    assert all(got[x][:2] == want[x][:2] and abs(got[x][2] - want[x][2]) < 1e-6 for x in want)
    x = [np.diff(np.log(np.maximum(v, 1)), prepend=0.0) for v in series.values()]
    for a, b in zip(regimes.hmm_regimes(x, cells=1), regimes.hmm_regimes(x)):
        assert all(np.allclose(a[n], b[n]) for n in a)
    assert K.hmm_regime(df.limit(0), "k", ["i"], "v", "i").count() == 0
