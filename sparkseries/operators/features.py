"""Feature vectors: per key, per window of a key, and per row of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation, epoch, first_reason, guarded, ratio
from ..functions.windows import Series, streak
from .clean import lifecycle_window, peak_ts
from .joins import future_windows, history_at, origins, padded_windows, sliding_windows


def outcome_features(df: DataFrame, by: str, ts: str, v: str, volume: str, holders: str) -> DataFrame:
    """By key: peak, value / volume / holder rates per hour up to the peak, holder rate after it, most holders."""
    marked = df.withColumn("_p", peak_ts(by, ts, v))
    at, before, after = F.col(ts) == F.col("_p"), F.col(ts) <= F.col("_p"), F.col(ts) > F.col("_p")
    g = marked.groupBy(by).agg(
        F.max(v).alias("peak"), F.max(holders).alias("max_holders"), F.min_by(v, ts).alias("v0"), F.min_by(holders, ts).alias("h0"), F.max(F.when(at, F.col(holders))).alias("hp"), F.max_by(holders, ts).alias("h1"),
        F.sum(F.when(before, F.col(volume))).alias("vol"), F.min(ts).alias("t0"), F.max("_p").alias("tp"), F.max(ts).alias("t1"), F.count(F.when(after, 1)).alias("n_after"))
    up, down = F.greatest((epoch("tp") - epoch("t0")) / 3600, F.lit(1.0)), F.greatest((epoch("t1") - epoch("tp")) / 3600, F.lit(1.0))
    return g.select(by, "peak", ((F.col("peak") - F.col("v0")) / up).alias("price_roc"), (F.col("vol") / up).alias("volume_roc"), ((F.col("hp") - F.col("h0")) / up).alias("holder_roc"),
                    F.when(F.col("n_after") > 0, (F.col("h1") - F.col("hp")) / down).otherwise(0.0).alias("holder_decay_roc"), "max_holders")


def lifecycle_features(df: DataFrame, by: str, ts: str, v: str, volume: str, holders: str, threshold: float, decay: float = 0.3) -> DataFrame:
    """By key that crosses the threshold: rise and decay hours, rates of value, volume and holders in both
    phases, peak, holders at the peak, total hours, share of the rise, most holders, last value."""
    rows = lifecycle_window(df, by, ts, v, threshold, decay)
    at = F.col(ts) == F.col("peak_ts")
    g = rows.groupBy(by).agg(F.max("t0").alias("t0"), F.max("peak_ts").alias("tp"), F.max("end_ts").alias("t1"), F.max("peak").alias("peak"), F.min_by(v, ts).alias("v0"), F.max_by(v, ts).alias("v1"), F.min_by(holders, ts).alias("h0"),
                             F.max_by(holders, ts).alias("h1"), F.max(F.when(at, F.col(holders))).alias("hp"), F.max(holders).alias("max_holders"), F.sum(F.when(F.col("phase") == "rise", F.col(volume))).alias("vol"))
    up, down = (epoch("tp") - epoch("t0")) / 3600, (epoch("t1") - epoch("tp")) / 3600
    u, d = F.greatest(up, F.lit(1.0)), F.greatest(down, F.lit(1.0))
    return g.select(by, up.alias("rise_hours"), ((F.col("peak") - F.col("v0")) / u).alias("price_roc"), (F.col("vol") / u).alias("volume_roc"), ((F.col("hp") - F.col("h0")) / u).alias("holder_roc"), "peak", F.col("hp").alias("holders_at_peak"),
                    down.alias("decay_hours"), ((F.col("h1") - F.col("hp")) / d).alias("holder_decay_roc"), ((F.col("v1") - F.col("peak")) / d).alias("price_decay_roc"), (up + down).alias("total_hours"), F.coalesce(ratio(up, up + down), F.lit(0.0)).alias("rise_share"), "max_holders", F.col("v1").alias("last_value"))


def outcome_speeds(df: DataFrame, by: str, ts: str, v: str) -> DataFrame:
    """By key: rise multiple, rise per hour, retention at the end, decay per hour."""
    marked = df.withColumn("_p", peak_ts(by, ts, v))
    g = marked.groupBy(by).agg(F.max(v).alias("p"), F.min_by(v, ts).alias("a"), F.max_by(v, ts).alias("z"), F.min(ts).alias("t0"), F.max("_p").alias("tp"), F.max(ts).alias("t1"))
    up, down = F.greatest((epoch("tp") - epoch("t0")) / 3600, F.lit(1.0)), F.greatest((epoch("t1") - epoch("tp")) / 3600, F.lit(1.0))
    return g.select(by, guarded("p", "a").alias("rise_multiple"), (guarded("p", "a") / up).alias("rise_speed"), ratio("z", "p").alias("retention"), ((1 - ratio("z", "p")) / down).alias("decay_speed"))


def window_features(bars: DataFrame, keys: DataFrame, by: str, ts: str, v: str, volume: str, hours: float = 24, step: float = 6) -> DataFrame:
    """One row for each (key, window) with price and volume features of its closed interval.

    Returns are guarded by max(x, 1); volatility is the population deviation of row-to-row returns; peak position
    and momentum shift count rows of the window.
    """
    rows = sliding_windows(bars.select(by, ts, v, volume), keys, by, ts, hours, step)
    w = Window.partitionBy(by, "win").orderBy(ts)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(by, "win")), "_r": guarded(v, F.lag(v).over(w)) - 1, "_d": F.col(v) / F.greatest(F.max(v).over(past), F.lit(1.0)) - 1})
    late, half = F.col("offset_h") >= hours - 6, F.col("offset_h") >= hours / 2
    first_late = F.min_by(F.when(late, F.col(v)), F.when(late, F.col(ts)))
    first_half = F.min_by(F.when(half, F.col(v)), F.when(half, F.col(ts)))
    peak = F.min_by("_i", F.struct((-F.col(v)).alias("v"), F.col("_i").alias("i")))
    a, z = F.min_by(v, ts), F.max_by(v, ts)
    return x.groupBy(by, "win", "t_start").agg(
        F.count("*").alias("rows"), a.alias("start"), z.alias("end"), F.max(v).alias("max"), F.min(v).alias("min"), (z / F.greatest(a, F.lit(1.0)) - 1).alias("return"), ((F.max(v) - F.min(v)) / F.greatest(a, F.lit(1.0))).alias("range"),
        (z / F.greatest(first_late, F.lit(1.0)) - 1).alias("return_6h"), (z / F.greatest(first_half, F.lit(1.0)) - 1).alias("return_half"), F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("volatility"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("mean_return"),
        F.min("_d").alias("max_drawdown"), F.coalesce(F.avg(F.when(F.col("_i") * 2 > F.col("_n"), F.col("_r"))) - F.avg(F.when(F.col("_i") * 2 <= F.col("_n"), F.col("_r"))), F.lit(0.0)).alias("momentum_shift"),
        (peak / F.count("*")).alias("peak_position"), F.sum(volume).alias("volume_total"), F.avg(volume).alias("volume_mean"),
        (F.coalesce(F.avg(F.when(F.col("_i") * 2 > F.col("_n"), F.col(volume))), F.lit(0.0)) / F.greatest(F.coalesce(F.avg(F.when(F.col("_i") * 2 <= F.col("_n"), F.col(volume))), F.lit(0.0)), F.lit(1.0)) - 1).alias("volume_trend"),
        (F.max(volume) / F.greatest(F.sum(volume), F.lit(1.0))).alias("volume_concentration"))


def holder_features(metric: DataFrame, keys: DataFrame, by: str, ts: str, h: str, hours: float = 24, step: float = 6, pad: float = 1) -> DataFrame:
    """Start, end, growth and rows of a metric within padded windows."""
    rows = padded_windows(metric.select(by, ts, h), keys, by, ts, hours, step, pad)
    a, z = F.min_by(h, ts), F.max_by(h, ts)
    return rows.groupBy(by, "win").agg(a.alias("m_start"), z.alias("m_end"), (z / F.greatest(a, F.lit(1.0)) - 1).alias("m_growth"), F.count("*").alias("m_rows"))


def window_corr(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of two columns in each group; 0 where it is undefined."""
    return rows.groupBy(*by).agg(F.coalesce(correlation(x, y), F.lit(0.0)).alias("corr"))


def early_features(bars: DataFrame, by: str, ts: str, v: str, volume: str, hours: float = 24) -> DataFrame:
    """By key over its first ``hours``: sub-window returns (1/6, 1/3, 1/2), acceleration, hours to the peak,
    volume deviation, share of the busiest hour."""
    keys = bars.groupBy(by).agg(F.min(ts).alias("t0"))
    rows = bars.join(keys, by).withColumn("h", (epoch(ts) - epoch("t0")) / 3600).where(F.col("h") <= hours)
    last = lambda part: F.max_by(F.when(F.col("h") <= hours * part, F.col(v)), F.when(F.col("h") <= hours * part, F.col(ts)))
    g = rows.groupBy(by).agg(F.min_by(v, ts).alias("a"), last(1 / 6).alias("p1"), last(1 / 3).alias("p2"), last(1 / 2).alias("p3"), F.min_by("h", F.struct((-F.col(v)).alias("v"), F.col("h"))).alias("hours_to_peak"), F.stddev_samp(volume).alias("volume_std"), F.sum(volume).alias("vol"))
    busy = rows.groupBy(by, F.floor("h").alias("hour")).agg(F.sum(volume).alias("x")).groupBy(by).agg(F.max("x").alias("busiest"))
    ret = lambda p: F.col(p) / F.greatest(F.col("a"), F.lit(1.0)) - 1
    return g.join(busy, by).select(by, ret("p1").alias("return_a"), ret("p2").alias("return_b"), ret("p3").alias("return_c"), (ret("p3") - ret("p2") - (ret("p2") - ret("p1"))).alias("acceleration"), "hours_to_peak", F.coalesce("volume_std", F.lit(0.0)).alias("volume_std"), guarded("busiest", "vol").alias("hour_concentration"))


def flow_features(rows: DataFrame, by: list[str], ts: str, buy: str, sell: str) -> DataFrame:
    """Net flow sum, mean and trend (younger less older half), buy/sell ratio, share of positive rows."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("_net", F.col(buy) - F.col(sell)).withColumns({"_i": F.row_number().over(w.orderBy(ts)), "_n": F.count("*").over(w)})
    young = F.col("_i") * 2 > F.col("_n")
    return x.groupBy(*by).agg(F.sum("_net").alias("net_sum"), F.avg("_net").alias("net_mean"), (F.coalesce(F.avg(F.when(young, F.col("_net"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~young, F.col("_net"))), F.lit(0.0))).alias("net_trend"), (F.sum(buy) / F.greatest(F.sum(sell), F.lit(1.0))).alias("buy_sell_ratio"), F.avg((F.col("_net") > 0).cast("double")).alias("positive_share"))


def history_features(bars: DataFrame, keys: DataFrame, by: str, ts: str, v: str, hours: float, step: float) -> DataFrame:
    """For each window: peak, rows, age, return and ratio to the peak of the key's past before the window."""
    windows = sliding_windows(bars.select(by, ts), keys, by, ts, hours, step).select(by, "win", "t_start").distinct()
    found = history_at(bars, windows, by, ts, v).join(keys.select(by, "origin"), by)
    return found.select(by, "win", "h_peak", F.coalesce("h_rows", F.lit(0)).alias("h_rows"), ((epoch("t_start") - epoch("origin")) / 3600).alias("h_age_hours"), (F.col("h_last") / F.greatest(F.col("h_first"), F.lit(1.0)) - 1).alias("h_return"), (F.col("h_last") / F.greatest(F.col("h_peak"), F.lit(1.0))).alias("h_of_peak"))


def future_labels(bars: DataFrame, keys: DataFrame, ends: DataFrame, by: str, ts: str, v: str, hours: float, step: float, horizon: float, up: float, down: float, min_rows: int = 2) -> DataFrame:
    """Label of each window of ``ends(key, win, end)`` from the extremes of (t_end, t_end + horizon]."""
    rows = future_windows(bars.select(by, ts, v), keys, by, ts, hours, step, horizon)
    future = rows.groupBy(by, "win").agg(F.max(v).alias("f_max"), F.min(v).alias("f_min"), F.count("*").alias("f_rows")).where(F.col("f_rows") >= min_rows)
    base = F.greatest(F.col("end"), F.lit(1.0))
    out = ends.join(future, [by, "win"]).withColumn("max_multiple", F.col("f_max") / base).withColumn("min_multiple", F.col("f_min") / base)
    return out.withColumn("label", F.when(F.col("max_multiple") >= up, "pump").when(F.col("min_multiple") <= down, "dump").otherwise("flat"))


def window_samples(bars: DataFrame, by: str, ts: str, v: str, volume: str, threshold: float | None, hours: float = 24, step: float = 6, horizon: float = 48, up: float = 2.0, down: float = 0.5) -> DataFrame:
    """The sliding-window data set: features, history and label of every window of every key."""
    keys = origins(bars, by, ts, v, threshold)
    features = window_features(bars, keys, by, ts, v, volume, hours, step)
    labels = future_labels(bars, keys, features.select(by, "win", "end"), by, ts, v, hours, step, horizon, up, down).drop("end")
    return features.join(history_features(bars, keys, by, ts, v, hours, step), [by, "win"]).join(labels, [by, "win"])


def outcome_label(bars: DataFrame, by: str, ts: str, v: str, holders: str, scam_holders: float, rug_drop: float, runner_multiple: float) -> DataFrame:
    """scam (too few holders ever), rug (one-row fall beyond ``rug_drop``), runner (multiple reached), mid; in this order."""
    s = Series(by, ts)
    g = bars.withColumn("_r", ratio(v, s.lag(v)) - 1).groupBy(by).agg(F.max(holders).alias("max_holders"), F.min("_r").alias("worst"), (F.max(v) / F.greatest(F.min_by(v, ts), F.lit(1.0))).alias("multiple"))
    rules: list[tuple[str, Column]] = [("scam", F.col("max_holders") < scam_holders), ("rug", F.col("worst") <= -rug_drop), ("runner", F.col("multiple") >= runner_multiple)]
    return g.withColumn("label", first_reason(rules, "mid"))


# --- row features -----------------------------------------------------------------------------------


def life_signals(df: DataFrame, s: Series, v: str, volume: str, holders: str) -> DataFrame:
    """Holder trend, acceleration and velocity, volume trend, surge and dry run, three growth rates, distance to
    VWAP, drawdown, range position."""
    out = df.withColumns({
        "holder_trend": s.roc(holders, 6, head=0.0), "holder_accel": F.coalesce(s.roc_accel(holders, 3, 3), F.lit(0.0)), "holder_velocity": F.coalesce(s.diff(holders), F.lit(0)).cast("double"),
        "volume_trend": F.coalesce(s.split_half_trend(volume, 12), F.lit(0.0)), "volume_surge": F.coalesce(s.rvol(volume, 12), F.lit(1.0)), "roc_1": s.roc(v, 1, head=0.0), "roc_3": s.roc(v, 3, head=0.0), "roc_6": s.roc(v, 6, head=0.0),
        "vwap_gap": ratio(v, s.vwap(v, volume, 12)) - 1, "drawdown": s.drawdown(v), "range_position": s.range_position(v, 12)})
    return streak(out, s, F.coalesce(ratio(volume, F.avg(volume).over(s.frame(24))), F.lit(0.0)) < 0.5, "dry_rows", cap=24)


def momentum_features(df: DataFrame, s: Series, v: str, volume: str, idx: str) -> DataFrame:
    """Point-in-time vector: growth at several lags, volatility, slopes, volume ratios, drawdown and range places."""
    made = {f"roc_{p}": s.roc(v, p, head=0.0) for p in (1, 2, 4, 8, 12, 24)}
    made |= {f"vol_{n}": F.coalesce(s.rolling("_r", n, "stddev_pop", 2), F.lit(0.0)) for n in (6, 12, 24)}
    made |= {f"slope_{n}": F.coalesce(ratio(s.trend_slope(v, idx, n), v), F.lit(0.0)) for n in (6, 12)}
    made |= {f"position_{n}": s.range_position(v, n) for n in (12, 24)}
    made |= {f"rvol_{n}": F.coalesce(s.rvol(volume, n), F.lit(1.0)) for n in (12, 24)}
    made |= {"ma_gap_12": s.ma_deviation(v, 12), "ma_gap_24": s.ma_deviation(v, 24), "drawdown": s.drawdown(v), "age": F.log1p(F.col(idx).cast("double")), "accel": F.coalesce(s.roc_accel(v, 4, 4), F.lit(0.0))}
    return df.withColumn("_r", s.roc(v, 1)).withColumns(made).drop("_r")


def position_features(df: DataFrame, s: Series, v: str, volume: str) -> DataFrame:
    """Rolling inputs of the position model: growth, sample volatility, volume trend (MA4 - MA12) / MA12, VWAP distance."""
    ma4, ma12 = F.avg(volume).over(s.frame(4)), F.avg(volume).over(s.frame(12))
    return df.withColumns({"roc_1": s.roc(v, 1, head=0.0), "roc_4": s.roc(v, 4, head=0.0), "roc_12": s.roc(v, 12, head=0.0)}).withColumns({"std_12": F.coalesce(s.rolling("roc_1", 12, "stddev_samp", 2), F.lit(0.0)), "volume_trend": F.coalesce(ratio(ma4 - ma12, ma12), F.lit(0.0)), "vwap_ratio": ratio(v, s.vwap(v, volume, 24)), "off_peak": s.drawdown(v)})


def funnel_features(df: DataFrame, s: Series, v: str, volume: str, idx: str) -> DataFrame:
    """Tick vector of the funnel: fraction growth (0 before enough rows), accelerations, VWAP slope, volume trend,
    drawdown, bearish run, time since the peak."""
    out = df.withColumns({f"roc_{p}": s.roc(v, p, head=0.0) for p in (1, 3, 6, 12, 24)})
    out = out.withColumns({"accel_3": F.coalesce(F.col("roc_3") - s.lag("roc_3", 3), F.lit(0.0)), "vwap": s.vwap(v, volume, 24), "std_12": F.coalesce(s.rolling("roc_1", 12, "stddev_pop", 1), F.lit(0.0)), "volume_trend": F.coalesce(s.split_half_trend(volume, 12), F.lit(0.0)), "drawdown": s.drawdown(v)})
    out = out.withColumns({"vwap_gap": ratio(v, "vwap") - 1, "vwap_slope": F.coalesce(ratio("vwap", s.lag("vwap", 6)) - 1, F.lit(0.0)), "since_peak": F.col(idx) - F.last(F.when(F.col(v) == s.running_max(v), F.col(idx)), ignorenulls=True).over(s.past)})
    return streak(out, s, F.col("roc_1") < 0, "bearish_run", cap=12)


def with_position(ticks: DataFrame, entry_value: str, v: str, tick: str) -> DataFrame:
    """Position state of an open trade on each tick: gain, peak gain so far, fall from it, rows held."""
    w = Window.partitionBy("entry_id").orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    gain = ratio(v, entry_value) - 1
    return ticks.withColumn("gain", gain).withColumn("peak_gain", F.max("gain").over(w)).withColumn("off_peak", F.col("gain") - F.col("peak_gain")).withColumn("held", F.col(tick))


def momentum_quality(df: DataFrame, by: str, signals: list[str], tighten_below: float = -0.5, extend_above: float = 0.5) -> DataFrame:
    """Mean of the non-null signals, each divided by its sample deviation in the series and clipped to [-1, 1],
    with flags to tighten a stop or to extend a hold."""
    w = Window.partitionBy(by)
    scaled = [F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c) / F.when(F.stddev_samp(c).over(w) > 0, F.stddev_samp(c).over(w)))) for c in signals]
    # greatest and least skip NULLs, so NULL signals are put back
    parts = F.array(*[F.when(F.col(c).isNotNull() & (F.stddev_samp(c).over(w) > 0), x) for c, x in zip(signals, scaled)])
    known = F.array_compact(parts)
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(known))
    return df.withColumn("quality", mean).withColumns({"tighten_stop": F.coalesce(F.col("quality") < tighten_below, F.lit(False)), "extend_hold": F.coalesce(F.col("quality") > extend_above, F.lit(False))})

