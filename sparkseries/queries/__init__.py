"""Registered queries: every operator bound to the driver's tables, with SQL for the same rows where SQL can say it.

``events`` serves as bars (``bars_u``: one bar for each event of a user; ``bars_h``: hourly bars of an event
type), ``lineitem`` as trades, ``embeddings`` as points. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded_double(c: str, digits: int) -> Column:
    """Rounded as the SQL side rounds a double: times 10^digits, to the nearest whole number (halves away from 0) and back. ``F.round`` looks at
    the shortest decimal text instead and decides some halves the other way."""
    y = F.abs(F.col(c)) * F.lit(10.0**digits)
    whole = F.floor(y).cast("double")
    near = F.when(y < 2.0**52, whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(y) / F.lit(10.0**digits)
    return F.when(y < float("inf"), F.signum(c) * near).otherwise(F.col(c)) + F.lit(0.0)


def query(sql: str | None = None, floats: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under the function's name; ``floats`` names the result's double columns."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[rounded_double(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats.split())
            ORACLE_SQL[fn.__name__] = f"SELECT *{f' REPLACE ({rounded})' if rounded else ''} FROM ({sql})"
        return run

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import clean, joins, kernels, models, sources, stats, streams, topk, windows  # noqa: F401

    return QUERIES, ORACLE_SQL
