"""Joins between series: equality on time buckets, as-of, windows with a per-key origin, intervals.

No operator here uses an inequality join: intervals on a time grid become window numbers that are computed
and exploded, and as-of look-ups are windows over the tagged union of both sides, so every plan has one
exchange by key and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch, ratio
from ..functions.windows import Series


def hourly_join(bars: DataFrame, metrics: DataFrame, by: str, hour: str, value: str, metric: str) -> DataFrame:
    """Inner join on (key, hour) with the value per unit of the metric (0 where the metric is 0 or missing).

    ``metrics`` must hold one row for each (key, hour): see ``last_per_bucket``.
    """
    return bars.join(metrics, [by, hour]).withColumn(f"{value}_per_{metric}", F.coalesce(ratio(value, metric), F.lit(0.0)))


def last_per_bucket(df: DataFrame, by: str, ts: str, bucket: Column, cols: list[str], name: str = "bucket") -> DataFrame:
    """The last row of each (key, bucket)."""
    last = F.max_by(F.struct(*cols), F.struct(F.col(ts), *cols))
    return df.groupBy(by, bucket.alias(name)).agg(last.alias("_x")).select(by, name, *[F.col(f"_x.{c}").alias(c) for c in cols])


def join_or_ffill(a: DataFrame, b: DataFrame, by: str, ts: str, a_col: str, b_col: str) -> DataFrame:
    """Keys with any common time keep their common rows; others take all times of both sides, filled forward."""
    full = a.select(by, ts, a_col, F.lit(True).alias("_a")).join(b.select(by, ts, b_col, F.lit(True).alias("_b")), [by, ts], "full")
    s = Series(by, ts)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    marked = full.withColumn("_both", both).withColumn("_some", F.max(F.col("_both")).over(s.all))
    filled = marked.withColumns({"_fa": s.ffill(a_col), "_fb": s.ffill(b_col)})
    kept = filled.where(F.col("_both") | (~F.col("_some") & F.col("_fa").isNotNull() & F.col("_fb").isNotNull()))
    return kept.select(by, ts, F.col("_fa").alias(a_col), F.col("_fb").alias(b_col), F.col("_some").alias("matched"))


def align_metrics(a: DataFrame, b: DataFrame, by: str, ts: str, a_col: str, b_col: str) -> DataFrame:
    """Both metrics at all times of either, linear between known points; rows before either begins drop out."""
    full = a.select(by, ts, a_col).join(b.select(by, ts, b_col), [by, ts], "full").withColumn("_x", epoch(ts))
    s = Series(by, ts)
    return full.select(by, ts, s.interpolate(a_col, "_x").alias(a_col), s.interpolate(b_col, "_x").alias(b_col)).where(F.col(a_col).isNotNull() & F.col(b_col).isNotNull())


def left_fill(df: DataFrame, metric: DataFrame, by: str, ts: str, col: str, default: float) -> DataFrame:
    """Sparse metric on every row: filled forward, then backward, then with the default."""
    s = Series(by, ts)
    joined = df.join(metric.select(by, ts, col), [by, ts], "left")
    return joined.withColumn(col, F.coalesce(s.ffill(col), s.bfill(col), F.lit(default)))


def asof_join(left: DataFrame, right: DataFrame, by: str, ts: str, cols: list[str], direction: str = "backward", tolerance: float | None = None, strict: bool = False, prefix: str = "") -> DataFrame:
    """Each left row with ``cols`` of the nearest right row of its key at or before it (forward: at or after).

    ``tolerance`` in seconds bounds the distance; ``strict`` excludes equal times. Right rows with equal key
    and time: the largest ``cols`` win. Left rows without a match keep NULLs; NULL keys match nothing.
    """
    lcols = left.columns
    back = direction == "backward"
    hit = F.struct(F.col(ts).alias("ts"), *[F.col(c) for c in cols])
    rights = right.groupBy(by, ts).agg(F.max(F.struct(*cols)).alias("_m")).select(by, ts, *[F.col(f"_m.{c}").alias(c) for c in cols])
    tag = 0 if (back != strict) else 2  # right rows sort before left rows of the same time, or after them
    a = left.select(F.col(by), F.col(ts), F.lit(1).alias("_tag"), F.struct(*[F.col(c) for c in lcols]).alias("_left"), F.lit(None).cast(rights.select(hit.alias("x")).schema[0].dataType).alias("_hit"))
    b = rights.select(F.col(by), F.col(ts), F.lit(tag).alias("_tag"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), hit.alias("_hit"))
    w = Window.partitionBy(by).orderBy(F.col(ts), "_tag")
    found = (F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    joined = a.unionByName(b).withColumn("_found", found).where(F.col("_left").isNotNull())
    ok = F.col(by).isNotNull()
    if tolerance is not None:
        ok = ok & (F.abs(epoch("_found.ts") - epoch(f"_left.{ts}")) <= tolerance)
    return joined.select(*[F.col(f"_left.{c}").alias(c) for c in lcols], *[F.when(ok, F.col(f"_found.{c}")).alias(prefix + c) for c in cols])


def value_at(df: DataFrame, events: DataFrame, by: str, ts: str, v: str, event_ts: str) -> DataFrame:
    """For each (key, event): value_at (last at or before the event, else the first), value_after (first after
    it, else the last) and value_last."""
    joined = events.select(by, event_ts).join(df.select(by, ts, v), by)
    before, after = F.col(ts) <= F.col(event_ts), F.col(ts) > F.col(event_ts)
    pick = lambda fn, cond: fn(F.when(cond, F.col(v)), F.when(cond, F.col(ts)))
    return joined.groupBy(by, event_ts).agg(
        F.coalesce(pick(F.max_by, before), F.min_by(v, ts)).alias("value_at"),
        F.coalesce(pick(F.min_by, after), F.max_by(v, ts)).alias("value_after"),
        F.max_by(v, ts).alias("value_last"))


# --- windows with a per-key origin ------------------------------------------------------------------


def origins(bars: DataFrame, by: str, ts: str, v: str | None = None, threshold: float | None = None) -> DataFrame:
    """(key, origin, last_ts): the first crossing of a threshold (or the first row) and the last row."""
    start = F.min(F.col(ts)) if threshold is None else F.min(F.when(F.col(v) >= threshold, F.col(ts)))
    return bars.groupBy(by).agg(start.alias("origin"), F.max(ts).alias("last_ts")).where("origin is not null")


def _indices(offset: Column, before: float, after: float, step: float, last: Column) -> Column:
    """Window numbers i with i * step + before <= offset <= i * step + after, as an array (maybe empty)."""
    low = F.greatest(F.ceil((offset - after) / step), F.lit(0))
    high = F.least(F.floor((offset - before) / step), last)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def explode_windows(rows: DataFrame, keys: DataFrame, by: str, ts: str, hours: float, step: float, before: float = 0.0, after: float | None = None, open_left: bool = False) -> DataFrame:
    """``rows`` once for each window of their key that covers them, with win, t_start and offset_h.

    Window i of a key is [origin + i * step, that + hours] in hours, closed at both ends; it must end at or
    before ``last_ts``. ``before`` and ``after`` (hours from the window's start) move the bounds that rows
    are held to, which is how padded, future and other intervals are written; ``open_left`` leaves the
    lower bound out.
    """
    after = hours if after is None else after
    joined = rows.join(keys.select(by, "origin", "last_ts"), by)
    offset = (epoch(ts) - epoch("origin")) / 3600
    last = F.floor((epoch("last_ts") - epoch("origin")) / 3600 / step - hours / step)
    out = joined.withColumn("win", F.explode(_indices(offset, before, after, step, last)))
    start = F.timestamp_micros((F.unix_micros("origin") + F.col("win") * F.lit(int(step * 3_600_000_000))).cast("bigint"))
    out = out.withColumn("t_start", start).withColumn("offset_h", (epoch(ts) - epoch("t_start")) / 3600)
    return (out.where(F.col("offset_h") > before) if open_left else out).drop("origin", "last_ts")


def sliding_windows(bars: DataFrame, keys: DataFrame, by: str, ts: str, hours: float = 24, step: float = 6) -> DataFrame:
    return explode_windows(bars, keys, by, ts, hours, step)


def padded_windows(metric: DataFrame, keys: DataFrame, by: str, ts: str, hours: float, step: float, pad: float) -> DataFrame:
    """Rows within ``pad`` hours around each window."""
    return explode_windows(metric, keys, by, ts, hours, step, before=-pad, after=hours + pad)


def future_windows(bars: DataFrame, keys: DataFrame, by: str, ts: str, hours: float, step: float, horizon: float) -> DataFrame:
    """Rows of (t_end, t_end + horizon] for each window."""
    return explode_windows(bars, keys, by, ts, hours, step, before=hours, after=hours + horizon, open_left=True)


def history_at(bars: DataFrame, windows: DataFrame, by: str, ts: str, v: str) -> DataFrame:
    """Running statistics of [first row, t_start) for each window: peak, first value, rows (as-of look-up of
    prefix aggregates, strict)."""
    s = Series(by, ts)
    prefix = bars.select(by, ts, s.running_max(v).alias("h_peak"), F.first(v).over(s.past).alias("h_first"), F.col(v).alias("h_last"), F.count("*").over(s.past).alias("h_rows"))
    return asof_join(windows.withColumn(ts, F.col("t_start")), prefix, by, ts, ["h_peak", "h_first", "h_last", "h_rows"], strict=True).drop(ts)


def entry_ticks(entries: DataFrame, bars: DataFrame, by: str, entry_idx: str, idx: str, max_hold: int = 48) -> DataFrame:
    """The rows from an entry on, at most ``max_hold``: entry numbers are spread over the row numbers they cover
    and joined on equality."""
    spread = entries.withColumn(idx, F.explode(F.sequence(F.col(entry_idx), F.col(entry_idx) + max_hold - 1)))
    return spread.join(bars, [by, idx]).withColumn("tick", F.col(idx) - F.col(entry_idx))


# --- keys and small dimensions ----------------------------------------------------------------------


def new_keys(found: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Keys (without case) that are not known."""
    return found.join(known.select(F.lower(on).alias("_k")).distinct(), F.lower(F.col(on)) == F.col("_k"), "left_anti")


def active_only(df: DataFrame, active: DataFrame, on: str) -> DataFrame:
    return df.join(active.select(F.lower(on).alias("_k")).distinct(), F.lower(F.col(on)) == F.col("_k"), "left_semi")


def open_positions(trades: DataFrame, positions: DataFrame, on: str, exit_time: str = "exit_time") -> DataFrame:
    return trades.where(F.col(exit_time).isNull()).join(positions, on)


def features_at_entry(trades: DataFrame, indicators: DataFrame, by: str, entry_idx: str, idx: str) -> DataFrame:
    """Indicator row at each trade's entry row."""
    return trades.join(indicators.withColumnRenamed(idx, entry_idx), [by, entry_idx])


def continuations(matches: DataFrame, series: DataFrame, by: str, matched_idx: str, idx: str, v: str) -> DataFrame:
    """What followed each match: highest, last and number of rows after it, relative to the matched value."""
    joined = matches.join(series.select(by, F.col(idx).alias("_i"), F.col(v).alias("_v")), by).where(F.col("_i") >= F.col(matched_idx))
    keys = [F.col(c) for c in matches.columns]
    at = F.min_by("_v", "_i")
    return joined.groupBy(*keys).agg((F.max("_v") / F.nullif(at, F.lit(0))).alias("best_multiple"), (F.max_by("_v", "_i") / F.nullif(at, F.lit(0))).alias("last_multiple"), (F.count("*") - 1).alias("rows_after"))


def map_labels(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Left join of a label table (Spark broadcasts it if it is small)."""
    return df.join(labels, on, "left")


def coverage_gap(coarse: DataFrame, fine: DataFrame, by: str, ts: str, step_seconds: float, need: float = 0.9) -> DataFrame:
    """By key: hours by which the fine series begins later than the coarse one, expected and found fine rows,
    and whether the key needs a refresh (below ``need`` of the expected rows)."""
    a = coarse.groupBy(by).agg(F.min(ts).alias("a0"), F.max(ts).alias("a1"))
    b = fine.groupBy(by).agg(F.min(ts).alias("b0"), F.count("*").alias("rows"))
    joined = a.join(b, by, "left")
    expected = F.floor((epoch("a1") - epoch("a0")) / step_seconds) + 1
    return joined.select(by, ((epoch("b0") - epoch("a0")) / 3600).alias("gap_hours"), expected.alias("expected"), F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) < need * expected).alias("refresh"))
