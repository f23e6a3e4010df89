"""Keyed tables in buckets: what a batch writes, repeated batches, compaction, old folders."""

from __future__ import annotations

import random

import pytest

from sparkseries.sources.keyed import KeyedTable

SCHEMA = "k long, ts long, v string"


def table(spark, at, **how):
    return KeyedTable(spark, f"file://{at}/t", ["k"], "ts", spark.createDataFrame([], SCHEMA).schema, **how)


def rows(t, before=None):
    return sorted((tuple(r) for r in t.read(before).collect()), key=repr)


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    t = table(spark, tmp_path, buckets=8)
    t.upsert(spark.range(400).selectExpr("id AS k", "1L AS ts", "'a' AS v"), 0)
    before = t.manifest()
    assert len(before) == 8
    change = spark.createDataFrame([(3, 2, "b"), (5, 0, "old"), (3, 1, "older")], SCHEMA)
    touched = t.upsert(change, 1)
    assert 1 <= len(touched) <= 2 and {b for b, f in t.manifest().items() if f != before[b]} == set(touched)
    want = sorted([(k, 1, "a") for k in range(400) if k != 3] + [(3, 2, "b")], key=repr)
    assert rows(t) == want
    assert t.upsert(change, 1) == touched and rows(t) == want and t.batches() == [0, 1]  # repeated
    assert t.upsert(spark.createDataFrame([], SCHEMA), 2) == [] and rows(t) == want


@pytest.mark.parametrize("most", [1, 3])
def test_batches_with_compaction_equal_the_last_row_of_each_key(spark, tmp_path, most):
    r, t, have = random.Random(most), table(spark, tmp_path, buckets=3, max_deltas=most), {}
    for i in range(6):
        new = [(r.randrange(12), r.randrange(5), f"{i}.{j}") for j in range(6)]
        new = list({k: (k, ts, v) for k, ts, v in new}.values()) + ([(None, i, "null")] if i % 2 else [])
        t.upsert(spark.createDataFrame(new, SCHEMA), i)
        for k, ts, v in new:
            if k not in have or ts >= have[k][1]:
                have[k] = (k, ts, v)
        assert rows(t) == sorted(have.values(), key=repr)
    assert max(len(f) for f in t.manifest().values()) <= most and any(f[0].startswith("base=") for f in t.manifest().values())


def test_readers_of_an_uncommitted_batch_see_the_one_before(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)
    t.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    t._write(spark.createDataFrame([(1, 9, "lost")], SCHEMA), "delta=1")  # a job that ended before its commit
    assert rows(t) == [(1, 1, "a")]
    t.upsert(spark.createDataFrame([(1, 2, "b")], SCHEMA), 1)
    assert rows(t) == [(1, 2, "b")] and rows(t, 1) == [(1, 1, "a")]


def test_insert_if_absent_and_vacuum(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2, max_deltas=1)
    for i in range(5):
        t.insert_if_absent(spark.createDataFrame([(1, i + 5, f"n{i}"), (i, 3, "later"), (i, 2, "first")], SCHEMA), i)
    want = [(0, 2, "first"), (1, 5, "n0"), (2, 2, "first"), (3, 2, "first"), (4, 2, "first")]
    assert rows(t) == want
    t.vacuum(keep=1)
    assert rows(t) == want and t.batches() == [4]
    t.vacuum(keep=1)
    assert rows(t) == want
    assert rows(table(spark, tmp_path / "none")) == []
