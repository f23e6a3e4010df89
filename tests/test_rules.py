"""Positions sold by rule tables against a row-by-row account."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkseries.operators import rules as Q
from sparkseries.operators.rules import Rule

RULES = [Rule("out", 1.0, "gain < -0.5"), Rule("half", 0.5, "off_peak < -0.3 AND x > 0"), Rule("bit", 0.125, "best > 0.2 AND x IS NULL")]


def account(rows):
    """(return without slippage, sales, rows held, [(before, action, after)]) of one key's (value, x)."""
    first, top, best, left, made, sales, held, log = rows[0][0], rows[0][0], 0.0, 1.0, 0.0, 0, None, []
    for i, (v, x) in enumerate(rows):
        top, gain = max(top, v), (v - first) / max(first, 1)
        best, off = max(best, gain), v / top - 1 if top > 0 else 0.0
        part, action = next(((p, a) for p, a, ok in ((1.0, "out", gain < -0.5), (0.5, "half", off < -0.3 and x is not None and x > 0), (0.125, "bit", best > 0.2 and x is None)) if ok), (0.0, "HOLD"))
        sold = min(part, left)
        log.append((left, action if sold > 0 else "HOLD", left - sold))
        left, made, sales = left - sold, made + sold * gain, sales + (sold > 0)
        if left <= 0 and held is None:
            held = i + 1
    return made + left * gain, sales, held or len(rows), log


def test_rule_tables(spark):
    r = random.Random(6)
    keys = {f"k{k}": [(round(r.uniform(0, 60), 2), r.choice([None, -1, 1])) for _ in range(r.choice([1, 2, 30]))] for k in range(30)}
    df = spark.createDataFrame([(k, i, v, x) for k, rows in keys.items() for i, (v, x) in enumerate(rows)], "k string, i int, v double, x int").repartition(5)
    p = Q.position(df, "k", ["i"], "v")
    rules = RULES
    action, part = Q.first_rule(rules)
    sold = Q.sell(p, "k", ["i"], part, action)
    log = {(g.k, g.i): (g.before, g.action, g.after) for g in sold.collect()}
    found = {g.k: g for g in Q.managed(p, "k", ["i"], rules, 0.0).collect()}
    for k, rows in keys.items():
        made, sales, held, want = account(rows)
        assert [log[k, i] for i in range(len(rows))] == want
        assert abs(found[k].ret - made) < 1e-9 and (found[k].n_sales, found[k].held) == (sales, held)


def test_ladder_takes_each_step_once(spark):
    gains = [0.0, 0.3, 0.2, 1.2, 0.1, -0.3, 0.4, -0.9]
    df = spark.createDataFrame([("a", i, g) for i, g in enumerate(gains)], "k string, i int, gain double")
    got = df.withColumn("p", Q.ladder_part("k", ["i"], "gain", [(0.25, 0.125), (1.0, 0.25), (-0.2, 0.25), (-0.6, 1.0)])).orderBy("i").collect()
    assert [g.p for g in got] == [0, 0.125, 0, 0.25, 0, 0.25, 0, 1.0]


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "k string, i int, v double, x int")
    assert Q.managed(Q.position(empty, "k", ["i"], "v"), "k", ["i"], RULES[:1]).count() == 0
    one = Q.managed(Q.position(spark.createDataFrame([(None, 0, 5.0, 1)], empty.schema), "k", ["i"], "v"), "k", ["i"], []).select("k", "ret", "n_sales", "held")
    assert [tuple(x) for x in one.collect()] == [(None, 0.0, 0, 1)] and isinstance(Q.first_rule([])[0], type(F.lit(0)))


def test_rule_tables_use_all_signals():
    from sparkseries.queries import kernels as Q

    life, patient = (" ".join(r.when for r in rules) for rules in (Q.LIFE_RULES, Q.PATIENT))
    assert all(name in life for name in ("dry", "holders", "off_peak", "best", "roc_4", "roc_12", "joining", "flow", "gap"))
    assert all(r.when.startswith("v ") for r in Q.PATIENT) and "lasting" in patient  # bands of the value


def hindsight(v, variant):
    """(action, before, after) of each row from the entry on, with what is sold depending on the share left."""
    left, out, n = 1.0, [], len(v)
    for i, x in enumerate(v):
        if left <= 0.01:
            out.append(("HOLD", 0.0, 0.0))
            continue
        base, later = max(x, 1), v[i + 1 : i + 4]
        gain, upside, dip = (x - v[0]) / max(v[0], 1), (max(v[i:]) - x) / base, (min(v[i : i + 6]) - x) / base
        peak, more = len(later) == 3 and x >= max(later), left > 0.5
        at_peak = [("TP_50" if more else "TP_100", peak and gain > 1.5 and upside < 0.2)]
        cuts = [("SL_50" if more else "EXIT", gain < -0.2 and upside < 0.05), ("SL_25", gain < -0.15 and upside < 0.03 and dip < -0.05)]
        half = "TP_50" if more else "TP_25"
        if variant == "window":
            table = [("TP_100", i >= n - 2 and gain > 0.1), ("EXIT", i >= n - 2), ("EXIT", gain < -0.3 and upside < 0.1), *cuts, *at_peak, (half, peak and gain > 0.5 and dip < -0.2), ("TP_25", peak and gain > 0.2 and dip < -0.15)]
        else:
            table = [("HOLD", i == n - 1), ("EXIT", gain < -0.35), *at_peak, (half, peak and gain > 0.8 and dip < -0.15), ("TP_25", peak and gain > 0.3 and dip < -0.15), ("TP_50" if more else "TP_100", gain > 1 and dip < -0.25),
                     ("TP_25", gain > 0.5 and dip < -0.3 and upside < 0.3), ("EXIT", gain < -0.25 and upside < 0.1), *cuts]
        action = next((a for a, ok in table if ok), "HOLD")
        after = left - min(left, {"TP_25": 0.25, "SL_25": 0.25, "TP_50": 0.5, "SL_50": 0.5, "TP_100": 1.0, "EXIT": 1.0}.get(action, 0.0))
        out.append((action, left, after))
        left = after
    return out


def entry_values(spark, d):
    from sparkseries.queries.kernels import O, bars_u

    bars = {}
    for r in bars_u(spark, d).orderBy("k", *O).collect():
        bars.setdefault(r.k, []).append(r.v)
    return {f"{k}:{i}": v[i : i + 24] for k, v in bars.items() for i in range(len(v)) if v[i] >= 60}


def test_tick_actions_depend_on_the_share_left(spark):
    from sparkseries.queries import load_all

    d = "/root/testdata/sf0.001"
    got = {(r.entry_id, r.tick): (r.action, r.before, r.after) for r in load_all()[0]["h23_tick_actions"](spark, d).collect()}
    assert got == {(e, i): x for e, v in entry_values(spark, d).items() for i, x in enumerate(hindsight(v, "tick"))}
    assert {"TP_50", "TP_25", "EXIT"} <= {a for a, _, _ in got.values()}


def test_sales_depend_on_the_share_left(spark):
    df = spark.createDataFrame([(k, i, x) for k, xs in {"a": [1, 0, 1, 1, 2], "b": [2, 1, 1], "c": [None]}.items() for i, x in enumerate(xs)], "k string, i int, x int").repartition(3)
    got = Q.sell_by_share(df, "k", ["i"], [Rule("half", 0.5, "x = 1", ("rest", 1.0)), Rule("bit", 0.25, "x = 2")], "x")
    assert got.columns == ["k", "i", "x", "before", "action", "sold", "after"]
    assert sorted(tuple(r)[:2] + tuple(r)[3:] for r in got.collect()) == [("a", 0, 1.0, "half", 0.5, 0.5), ("a", 1, 0.5, "HOLD", 0.0, 0.5), ("a", 2, 0.5, "rest", 0.5, 0.0), ("a", 3, 0.0, "HOLD", 0.0, 0.0), ("a", 4, 0.0, "HOLD", 0.0, 0.0),
                                                                           ("b", 0, 1.0, "bit", 0.25, 0.75), ("b", 1, 0.75, "half", 0.5, 0.25), ("b", 2, 0.25, "rest", 0.25, 0.0), ("c", 0, 1.0, "HOLD", 0.0, 1.0)]


def test_label_actions_depend_on_the_share_left(spark):
    from sparkseries.queries import load_all

    d = "/root/testdata/sf0.001"
    got = {(r.entry_id, r.tick): (r.action, r.before, r.after) for r in load_all()[0]["h23_label_actions"](spark, d).collect()}
    assert got == {(e, i): x for e, v in entry_values(spark, d).items() for i, x in enumerate(hindsight(v, "window"))}


def test_replay_follows_the_actions(spark):
    from sparkseries.queries import load_all

    d = "/root/testdata/sf0.001"
    got = {r.entry_id: r for r in load_all()[0]["h25_replay_actions"](spark, d).collect()}
    values = entry_values(spark, d)
    assert got.keys() == values.keys()
    for e, v in values.items():
        gain, told = [(x - v[0]) / max(v[0], 1) for x in v], hindsight(v, "window")
        held = next(i for i, (_, _, after) in enumerate(told) if after <= 0.01) + 1
        assert abs(got[e].ret - sum((b - a) * g for g, (_, b, a) in zip(gain, told))) < 1e-5 and got[e].held == held
        assert abs(got[e].hold_ret - gain[-1]) < 1e-5 and abs(got[e].rules_ret - next((g for g in gain if g >= 1 or g <= -0.2), gain[-1])) < 1e-5
