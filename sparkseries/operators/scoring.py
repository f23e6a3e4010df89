"""Composite scores of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, freshness, grade, health, ramp, ratio, weighted

ENTRY_WEIGHTS = {"momentum": 0.25, "surge": 0.2, "pressure": 0.2, "fresh": 0.2, "health": 0.15}


def entry_score(df: DataFrame, change: str, volume: str, mean_volume: str, buys: str, sells: str, age_hours: str, current: str, peak: str, weights: dict[str, float] = ENTRY_WEIGHTS) -> DataFrame:
    """Ramps of growth, volume surge and buy pressure with freshness and health, weighted and rounded to ``score``."""
    return df.withColumns({
        "momentum": F.coalesce(ramp(change, 0.0, 1.0), F.lit(0.0)), "surge": F.coalesce(ramp(ratio(volume, mean_volume), 1.0, 5.0), F.lit(0.0)),
        "pressure": F.coalesce(ramp(ratio(buys, F.col(buys) + F.col(sells)), 0.4, 0.7), F.lit(0.0)), "fresh": F.coalesce(freshness(age_hours), F.lit(0.0)), "health": F.coalesce(health(current, peak, change), F.lit(0.0))}).withColumn("score", weighted(weights))


def sell_pressure(df: DataFrame, drawdown: str, volume_trend: str, holder_trend: str, dry_rows: str, vwap_gap: str) -> DataFrame:
    """Sum of the parts that hold, capped at 1."""
    parts: list[tuple[Column, float]] = [(F.col(drawdown) <= -0.3, 0.3), (F.col(volume_trend) < -0.3, 0.2), (F.col(holder_trend) < 0, 0.2), (F.col(dry_rows) >= 3, 0.15), (F.col(vwap_gap) < -0.05, 0.15)]
    total = sum((F.when(c, F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return df.withColumn("sell_pressure", F.least(total, F.lit(1.0)))


def graded(df: DataFrame, score: str, cuts: DataFrame, names: tuple[str, ...] = ("S", "A", "B", "C")) -> DataFrame:
    """Grade by quantile cuts (one row p99, p95, p90, p80: see ``stats.thresholds``)."""
    x = df.crossJoin(F.broadcast(cuts))  # one row
    out = F.when(F.col(score) >= F.col("p99"), names[0]).when(F.col(score) >= F.col("p95"), names[1]).when(F.col(score) >= F.col("p90"), names[2]).when(F.col(score) >= F.col("p80"), names[3]).otherwise("D")
    return x.select(*df.columns, out.alias("grade"))


def fixed_grade(df: DataFrame, score: str, thresholds: list[tuple[float, str]]) -> DataFrame:
    return df.withColumn("grade", grade(score, thresholds))


def residual_scores(candidates: DataFrame, fits: DataFrame, pairs: list[tuple[str, str, float]], key: str) -> DataFrame:
    """Residual z-scores over feature pairs (x, y, weight), clipped to +-5, and their weighted sum.

    ``fits`` has a row for each pair with column ``pair`` ("x~y") and the coefficients of ``stats.poly2_fit``.
    """
    table = F.broadcast(fits.agg(F.map_from_entries(F.collect_list(F.struct("pair", F.struct("x_mean", "c0", "c1", "c2", "sigma")))).alias("_f")))  # one row for each pair
    x = candidates.crossJoin(table)
    total = F.lit(0.0)
    for a, b, w in pairs:
        fit = F.col("_f")[f"{a}~{b}"]
        at = F.col(a) - fit["x_mean"]
        z = clip((F.col(b) - (fit["c0"] + fit["c1"] * at + fit["c2"] * at * at)) / F.nullif(fit["sigma"], F.lit(0.0)), -5.0, 5.0)
        x = x.withColumn(f"z_{a}_{b}", F.coalesce(z, F.lit(0.0)))
        total = total + F.lit(w) * F.col(f"z_{a}_{b}")
    return x.drop("_f").withColumn("composite", total)


def ranked(df: DataFrame, score: str, key: str, by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)))
