"""Filters, trimming, normalisation and set operations on keyed series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, col, epoch, first_reason, ratio
from ..functions.windows import Series

# --- trimming ---------------------------------------------------------------------------------------


def first_crossing(by: str, ts: str, v: str, threshold: float) -> Column:
    """Time of a key's first row at or above the threshold, on each of its rows."""
    return F.min(F.when(F.col(v) >= threshold, F.col(ts))).over(Window.partitionBy(by))


def trim_from_crossing(df: DataFrame, by: str, ts: str, v: str, threshold: float) -> DataFrame:
    """Rows from the first crossing on, with ``t0``; keys that never cross drop out."""
    return df.withColumn("t0", first_crossing(by, ts, v, threshold)).where(F.col(ts) >= F.col("t0"))


def elapsed_hours(ts: str, origin: str) -> Column:
    return (epoch(ts) - epoch(origin)) / 3600


def cap_horizon(df: DataFrame, ts: str, origin: str, hours: float) -> DataFrame:
    """Rows at most ``hours`` after the origin, with ``hours``."""
    return df.withColumn("hours", elapsed_hours(ts, origin)).where(F.col("hours") <= hours)


def peak_ts(by: str, ts: str, v: str) -> Column:
    """Time of a key's first maximum."""
    w = Window.partitionBy(by)
    return F.min(F.struct((-F.col(v)).alias("v"), F.col(ts).alias("ts"))).over(w)["ts"]


def trim_to_peak(df: DataFrame, by: str, ts: str, v: str) -> DataFrame:
    return df.withColumn("peak_ts", peak_ts(by, ts, v)).where(F.col(ts) <= F.col("peak_ts"))


def lifecycle_window(df: DataFrame, by: str, ts: str, v: str, threshold: float, decay: float = 0.3) -> DataFrame:
    """Rows from the crossing to the first value at or below ``decay`` times the peak after the peak (else the
    end), with t0, peak_ts, end_ts, peak and phase (rise up to the peak, then decay)."""
    w = Window.partitionBy(by)
    risen = trim_from_crossing(df, by, ts, v, threshold).withColumn("peak", F.max(v).over(w)).withColumn("peak_ts", peak_ts(by, ts, v))
    fell = F.min(F.when((F.col(ts) > F.col("peak_ts")) & (F.col(v) <= decay * F.col("peak")), F.col(ts))).over(w)
    ended = risen.withColumn("end_ts", F.coalesce(fell, F.max(ts).over(w))).where(F.col(ts) <= F.col("end_ts"))
    return ended.withColumn("phase", F.when(F.col(ts) <= F.col("peak_ts"), "rise").otherwise("decay"))


def require_min_rows(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(by))).where(F.col("_n") >= n).drop("_n")


def created_after(df: DataFrame, by: str, ts: str, t0) -> DataFrame:
    """Keys whose first row is at or after ``t0``."""
    return df.withColumn("_first", F.min(ts).over(Window.partitionBy(by))).where(F.col("_first") >= F.lit(t0)).drop("_first")


def positive(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(c) > 0 for c in cols)))


def every_nth(df: DataFrame, by: str, ts: str | list[str], n: int) -> DataFrame:
    """The first row of each key and every n-th after it."""
    s = Series(by, ts)
    return df.withColumn("_i", s.idx()).where(F.col("_i") % n == 0).drop("_i")


# --- normalisation ----------------------------------------------------------------------------------


def clip_sigma(df: DataFrame, by: str, v: str, n: float = 5.0, name: str | None = None) -> DataFrame:
    """Clip to mean +- n population deviations of the key's whole series (not causal)."""
    w = Window.partitionBy(by)
    mean, sigma = F.avg(v).over(w), F.stddev_pop(v).over(w)
    return df.withColumn(name or v, F.when(sigma > 0, F.greatest(mean - n * sigma, F.least(mean + n * sigma, F.col(v)))).otherwise(F.col(v)))


def robust_z(df: DataFrame, by: str, cols: list[str], suffix: str = "_rz") -> DataFrame:
    """(x - median) / IQR of the key's series; only centred where the IQR is 0."""
    from .stats import with_quantiles

    q = with_quantiles(df.groupBy(by).agg(F.count("*").alias("_rows")), df, (by,), {c: {f"_q1_{c}": 0.25, f"_q2_{c}": 0.5, f"_q3_{c}": 0.75} for c in cols})
    out = df.join(q.withColumnRenamed(by, "_of"), F.col(by).eqNullSafe(F.col("_of")))
    iqr = {c: F.col(f"_q3_{c}") - F.col(f"_q1_{c}") for c in cols}
    return out.select(*df.columns, *[((F.col(c) - F.col(f"_q2_{c}")) / F.when(iqr[c] > 0, iqr[c]).otherwise(1.0)).alias(c + suffix) for c in cols])


def zscore(df: DataFrame, by: str | None, cols: list[str], floor: float = 1e-8, suffix: str = "_z") -> DataFrame:
    """Population z-score by key, or over the whole table (``by`` None: one aggregate row is joined)."""
    if by is None:
        moments = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
        out = df.crossJoin(F.broadcast(moments))  # one row
        made = {c + suffix: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(floor)) for c in cols}
        return out.withColumns(made).drop(*moments.columns)
    w = Window.partitionBy(by)
    return df.withColumns({c + suffix: (F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(floor)) for c in cols})


def minmax(df: DataFrame, by: str, cols: list[str], suffix: str = "_mm") -> DataFrame:
    """To [0, 1] by key; 0 for constant series."""
    w = Window.partitionBy(by)
    return df.withColumns({c + suffix: F.coalesce(ratio(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)) for c in cols})


# --- predicates -------------------------------------------------------------------------------------


def scan_filter(df: DataFrame, s: Series, v: str, holders: str, min_value: float, min_holders: float, gain_rows: int, min_gain: float) -> DataFrame:
    """Rows with a value, a holder count and a gain over ``gain_rows`` rows that reach their limits; adds ``gain``."""
    return df.withColumn("gain", s.roc(v, gain_rows)).where((F.col(v) >= min_value) & (F.col(holders) >= min_holders) & (F.col("gain") >= min_gain))


def scam_filter(df: DataFrame, s: Series, v: str, holders: str, max_share_col: str | None, max_share: float, min_rows_to_peak: int, max_value_per_holder: float) -> DataFrame:
    """Rows that no scam rule catches, with the running peak: concentration too high, running peak reached
    within the first ``min_rows_to_peak`` rows and never again, or too much value per holder."""
    found = df.withColumn("run_peak", s.running_max(v)).withColumn("_i", s.idx())
    found = found.withColumn("peak_idx", F.min(F.struct((-F.col(v)).alias("v"), F.col("_i").alias("i"))).over(s.past)["i"])
    early = (F.col("peak_idx") < min_rows_to_peak) & (F.col("_i") >= 4 * min_rows_to_peak)
    rich = ratio(v, holders) > max_value_per_holder
    held = (F.col(max_share_col) > max_share) if max_share_col else F.lit(False)
    return found.where(~(early | F.coalesce(rich, F.lit(True)) | F.coalesce(held, F.lit(False)))).drop("_i")


def snapshot_filter(df: DataFrame, v: str, holders: str, min_holders: float, max_value_per_holder: float) -> DataFrame:
    """Adds ``reason``: why a snapshot is rejected, NULL if it is not."""
    rules = [("no_holders", F.col(holders).isNull()), ("few_holders", F.col(holders) < min_holders), ("value_per_holder", ratio(v, holders) > max_value_per_holder)]
    return df.withColumn("reason", first_reason(rules))


def safety_gate(df: DataFrame, holders: str, share: str, min_holders: float, max_share: float) -> DataFrame:
    """Adds ``safe`` and ``reason`` (unknown data is unsafe)."""
    rules = [("unknown", F.col(holders).isNull() | F.col(share).isNull()), ("few_holders", F.col(holders) < min_holders), ("concentrated", F.col(share) > max_share)]
    return df.withColumn("reason", first_reason(rules)).withColumn("safe", F.col("reason").isNull())


def entry_gate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reason``, the first condition (name, must hold) that fails or is NULL, and ``enter``."""
    return df.withColumn("reason", first_reason([(name, ~F.coalesce(cond, F.lit(False))) for name, cond in rules])).withColumn("enter", F.col("reason").isNull())


def breakout_gate(df: DataFrame, s: Series, ts: str, v: str, holders: str, swaps: str, max_age_hours: float = 6.0, near_high: float = 0.95, roc_rows: int = 6, min_roc: float = 0.05, min_growth: float = 0.0, min_swaps: float = 1.0) -> DataFrame:
    """Young series close to their running high that still rise in value and holders and have inflow."""
    age = (epoch(ts) - F.min(epoch(ts)).over(s.all)) / 3600
    out = df.withColumns({"age_hours": age, "of_high": ratio(v, s.running_max(v)), "roc": s.roc(v, roc_rows), "holder_growth": s.roc(holders, roc_rows)})
    return out.where((F.col("age_hours") < max_age_hours) & (F.col("of_high") >= near_high) & (F.col("roc") >= min_roc) & (F.col("holder_growth") > min_growth) & (F.col(swaps) >= min_swaps))


def search_registry(df: DataFrame, query: str, key: str, symbol: str) -> DataFrame:
    """Rows of the first tier with a match: symbol equal, key equal, either contains (all without case)."""
    q = F.lower(F.lit(query))
    tier = F.when(F.lower(symbol) == q, 1).when(F.lower(key) == q, 2).when(F.lower(symbol).contains(q) | F.lower(key).contains(q), 3)
    found = df.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("_best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best")  # one row


# --- set operations ---------------------------------------------------------------------------------


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def difference(df: DataFrame, *known: DataFrame, on: str) -> DataFrame:
    """Rows whose key (without case) is in none of the others."""
    out = df.withColumn("_k", F.lower(F.col(on).cast("string")))
    for k in known:
        out = out.join(k.select(F.lower(F.col(on).cast("string")).alias("_k")).distinct(), "_k", "left_anti")
    return out.drop("_k")


def distinct_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_timestamps(a: DataFrame, b: DataFrame, by: str, ts: str) -> DataFrame:
    return a.select(by, ts).union(b.select(by, ts)).distinct()


def keys_in_all(*dfs: DataFrame, on: str) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), (d.select(on) for d in dfs))


def fold_split(df: DataFrame, fold_col: str, i: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of fold i."""
    return df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)


def clip_column(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    return df.withColumn(c, clip(col(c), low, high))
