"""Timers, chained stateful operators and state with a time to live, over one and over several micro-batches."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkseries.queries.streams import EPISODE, ORDER, stated
from sparkseries.queries.views import ticks
from sparkseries.streaming import state as S
from sparkseries.streaming import timed as M

D = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
HOUR = 3_600_000


def episodes(t):
    return M.stream_timed(M.stream_timed(t, "k", ORDER, M.Growth, ["ts", "id", "v"], "ts", v="v", p=2), "k", ORDER, M.Episodes, idle_ms=5 * HOUR, **EPISODE)


JOBS = {
    "episodes": episodes,
    "positions": lambda t: M.stream_timed(t, "k", ORDER, M.TimedPositions, v="v", signal="signal", stop=40.0, hold_ms=6 * HOUR),
    "watch": lambda t: M.stream_timed(t.select((F.col("k") % 2).alias("p"), "ts", "id", "k"), "p", ORDER, M.Watchlist, token="k", max_size=3, ttl_ms=9 * HOUR),
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events in one file, and cut by time into seven."""
    at = tmp_path_factory.mktemp("timed")
    t = ticks(spark, D).select("k", "ts", "id", "v", (F.col("vol") > 70).alias("signal")).orderBy("ts")
    cuts = t.selectExpr("percentile(unix_micros(ts), array(0.01, 0.2, 0.4, 0.41, 0.7, 0.99)) AS c").first().c
    part = sum((F.unix_micros("ts") > c).cast("int") for c in cuts)
    for i in range(7):
        t.where(part == i).coalesce(1).write.mode("append").parquet(f"file://{at}/cut")
        time.sleep(0.01)
    t.coalesce(1).write.parquet(f"file://{at}/whole")
    return at, t.schema


@pytest.mark.parametrize("name", sorted(JOBS))
def test_results_do_not_depend_on_micro_batches(spark, files, name):
    at, schema = files
    found = []
    for kind in ("cut", "whole"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/{kind}").withWatermark("ts", "10 minutes")
        found.append(sorted((tuple(r) for r in stated(JOBS[name](stream), name).collect()), key=repr))
    assert found[0] == found[1] and found[0]


def streamed(spark, at, rows, schema, job, name):
    """The result of a job over rows that come in one micro-batch each."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{at}/{name}")
        time.sleep(0.01)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/{name}").withWatermark("ts", "1 minute")
    return stated(job(s), name).collect()


def hours(h):
    return T0 + timedelta(hours=h)


def test_a_timer_acts_without_a_row_of_its_key(spark, tmp_path):
    """Key 1 falls silent while key 2 moves the watermark on: its episode is censored at its last row, its position closed at the last value."""
    schema = "k long, ts timestamp, id long, v double, signal boolean"
    rows = [[(1, hours(h), h, float(10 + 20 * h), h == 1) for h in range(5)], [(2, hours(30), 1, 5.0, False)], [(2, hours(31), 2, 5.0, False)]]
    got = streamed(spark, tmp_path, rows, schema, episodes, "e")
    assert [(r.k, r.entry_idx, r.exit_idx, r.exit_value, r.observed) for r in got] == [(1, 2, 4, 90.0, False)]
    got = streamed(spark, tmp_path, rows, schema, JOBS["positions"], "p")
    assert [(r.k, r.entry_idx, r.exit_idx, r.exit_value, r.exit_reason, r.exit_ms) for r in got] == [(1, 1, 4, 90.0, "time_stop", int(hours(7).timestamp() - hours(0).timestamp()) * 1000 + 1704067200000)]


def test_entries_leave_the_list_without_a_row(spark, tmp_path):
    schema = "k long, ts timestamp, id long, v double, signal boolean"
    rows = [[(2, hours(0), 1, 0.0, False), (4, hours(1), 2, 0.0, False), (2, hours(2), 3, 0.0, False)], [(1, hours(10), 4, 0.0, False)], [(1, hours(40), 5, 0.0, False), (3, hours(40), 6, 0.0, False), (5, hours(41), 7, 0.0, False), (7, hours(42), 8, 0.0, False)]]
    got = sorted((r.p, r.at_ms // HOUR - 1704067200000 // HOUR, r.change, r.token) for r in streamed(spark, tmp_path, rows, schema, JOBS["watch"], "w"))
    assert got == [(0, 0, "added", "2"), (0, 1, "added", "4"), (0, 9, "expired", "2"), (0, 10, "expired", "4"),
                   (1, 10, "added", "1"), (1, 19, "expired", "1"), (1, 40, "added", "1"), (1, 40, "added", "3"), (1, 41, "added", "5"), (1, 42, "added", "7"), (1, 42, "full", "1")]


def test_state_with_a_time_to_live(spark, tmp_path):
    """A key without rows for longer than its time to live starts afresh; without one it goes on counting."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else processing time asks for one more batch for ever
    schema = "k long, ts timestamp, id long, v double"
    rows = [[(1, hours(i), i, 1.0)] for i in range(3)]
    job = lambda ttl: lambda s: S.stream_state(s, "k", ORDER, S.Indicators, ttl_ms=ttl, v="v", span=3, p=1)
    assert sorted(r.idx for r in streamed(spark, tmp_path, rows, schema, job(None), "a")) == [0, 1, 2]
    assert sorted(r.idx for r in streamed(spark, tmp_path, rows, schema, job(1), "b")) == [0, 0, 0]
    assert sorted(r.idx for r in streamed(spark, tmp_path, rows, schema, job(10**8), "c")) == [0, 1, 2]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_watchlist_asks_the_store_once_for_a_batch(spark):
    calls = []

    class Store(dict):
        def iterator(self):
            calls.append("read")
            return iter([((k,), (v,)) for k, v in self.items()])

        def updateValue(self, k, v):
            calls.append("write")
            self[k[0]] = v[0]

        def removeKey(self, k):
            calls.append("write")
            del self[k[0]]

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        store, value = Store(), Value()

        def getMapState(self, *_):
            return self.store

        def getValueState(self, *_):
            return self.value

        def registerTimer(self, _):
            pass

        def deleteTimer(self, _):
            pass

    p = M.Watchlist("p", ["ts", "id"], [], token="k", max_size=3, ttl_ms=3_600_000)
    p.init(Handle())
    t = pd.DataFrame({"p": 0, "ts": pd.to_datetime(np.arange(25_000), unit="s"), "id": range(25_000), "k": np.arange(25_000) // 2})
    log = pd.concat(list(p.handleInputRows((0,), iter([t.iloc[::-1]]), None)))
    assert len(calls) <= 4 and sorted(Handle.store) == ["12497", "12498", "12499"]
    assert (log.change == "added").sum() == 12_500 and (log.change == "full").sum() == 12_497
    assert log[log.change == "added"].token.astype(int).tolist() == list(range(12_500))


def test_timed_position_opened_at_zero(spark):
    p = M.TimedPositions("k", ["ts", "id"], [], v="v", signal="s", stop=40.0, hold_ms=1000)
    s = {"i": -1, "entry": None, "seen": None}
    assert p.step(s, {"v": 0.0, "s": True}, 0) == []
    assert [r["exit_reason"] for r in p.step(s, {"v": 0.0, "s": False}, 1)] == ["trailing_stop"]
