"""Every query with SQL returns the rows of its SQL on the smallest tables; the others return a stable schema."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from sparkseries.queries import load_all

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = load_all()


def canon(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    found = duck.execute(SQL[name])
    want = canon(found.fetchall(), [d[0] for d in found.description])
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    assert len(got) == len(want)
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4) if isinstance(a, float) and isinstance(b, float) else a == b for x, y in zip(got, want) for a, b in zip(x, y))


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and got.columns == ["k", "label", "n", "mean_multiple", "mean_drawdown"]
