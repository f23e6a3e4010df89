"""Bars on a time grid and per-key metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch, floor_ts
from ..functions.windows import Series


def resample_bars(df: DataFrame, by: str, ts: str, v: str, seconds: int, tie: str | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Open, high, low, close, n and given sums of each (key, bucket); ``tie`` orders equal times."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    sums = {name: F.sum(x).alias(name) for name, x in (sums or {}).items()}
    return df.groupBy(by, floor_ts(ts, seconds).alias("bucket")).agg(F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), F.count("*").alias("n"), *sums.values())


def resample_ffill(df: DataFrame, by: str, ts: str, v: str, seconds: int, tie: str | None = None) -> DataFrame:
    """Last value on a dense grid from a key's first to its last bucket, filled forward."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    last = df.groupBy(by, floor_ts(ts, seconds).alias("bucket")).agg(F.max_by(v, at).alias(v))
    ends = last.groupBy(by).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = ends.select(by, F.explode(F.sequence("a", "b", F.make_dt_interval(secs=F.lit(seconds)))).alias("bucket"))
    s = Series(by, "bucket")
    return grid.join(last, [by, "bucket"], "left").withColumn(v, s.ffill(v))


def trajectory_metadata(df: DataFrame, by: str, ts: str, v: str, companions: list[str]) -> DataFrame:
    """By key: rows, first and peak value, hour of the (first) peak since the first row, companions at the peak."""
    peak = F.max_by(F.struct(ts, *companions), F.struct(F.col(v), -epoch(ts)))
    out = df.groupBy(by).agg(F.count("*").alias("rows"), F.min_by(v, ts).alias("start_value"), F.max(v).alias("peak_value"), F.min(ts).alias("_t0"), peak.alias("_p"))
    return out.select(by, "rows", "start_value", "peak_value", ((epoch(F.col(f"_p.{ts}")) - epoch("_t0")) / 3600).alias("peak_hour"), *[F.col(f"_p.{c}").alias(f"{c}_at_peak") for c in companions])
