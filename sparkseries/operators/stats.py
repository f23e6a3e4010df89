"""Grouped statistics: trades, reports, distributions, regressions, survival curves, model quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation, epoch, first_reason, ratio, tags
from ..functions.windows import Series

# --- trades -----------------------------------------------------------------------------------------


def _trade_aggs(ret: str, held: str, peak: str | None) -> list[Column]:
    r = F.col(ret)
    win, loss = F.sum(F.when(r > 0, r)), -F.sum(F.when(r <= 0, r))
    mean_win, mean_loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r <= 0, r))
    out = [F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_return"), F.coalesce(win, F.lit(0.0)).alias("gross_profit"), F.coalesce(loss, F.lit(0.0)).alias("gross_loss"),
           (win / F.nullif(loss, F.lit(0.0))).alias("profit_factor"), mean_win.alias("mean_win"), mean_loss.alias("mean_loss"), (mean_win / F.nullif(-mean_loss, F.lit(0.0))).alias("win_loss_ratio"), F.avg(held).alias("mean_hold"), F.sum(r).alias("total_return")]
    if peak:
        out += [F.avg(peak).alias("mean_peak"), (F.avg(r) / F.nullif(F.avg(peak), F.lit(0.0))).alias("capture")]
    return out


def trade_stats(trades: DataFrame, by: list[str], ret: str = "return_pct", held: str = "bars_held", peak: str | None = None) -> DataFrame:
    """Number, win rate, mean and median return, gross profit and loss, profit factor, holding time and more, by group."""
    out = with_quantiles(trades.groupBy(*by).agg(*_trade_aggs(ret, held, peak)), trades, tuple(by), {ret: {"median_return": 0.5}})
    at = out.columns.index("mean_return") + 1
    return out.select(*out.columns[:at], "median_return", *[c for c in out.columns[at:] if c != "median_return"])


def stats_rollup(trades: DataFrame, key: str, ret: str = "return_pct", held: str = "bars_held") -> DataFrame:
    """The same for each key and overall (key NULL, ``overall`` 1)."""
    each = trade_stats(trades, [key], ret, held).withColumn("overall", F.lit(0))
    whole = trade_stats(trades.withColumn("_whole", F.lit(1)), ["_whole"], ret, held).withColumn("overall", F.lit(1))
    return each.unionByName(whole.withColumn(key, F.lit(None).cast(trades.schema[key].dataType)).drop("_whole"))


def risk_stats(trades: DataFrame, by: list[str], ret: str = "return_pct", order: list[str] | None = None, per_year: float = 252.0) -> DataFrame:
    """Sharpe of a trade (population), scaled by root n and by root of ``per_year``, worst trade, 5 % quantile, and the
    largest fall of the cumulative return with its ratio to the total (Calmar) if an order is given."""
    sharpe = F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0))
    aggs = [F.count("*").alias("n"), sharpe.alias("sharpe"), (sharpe * F.sqrt(F.count("*").cast("double"))).alias("sharpe_n"), (sharpe * float(per_year) ** 0.5).alias("sharpe_year"), F.min(ret).alias("worst")]
    if order is None:
        return with_quantiles(trades.groupBy(*by).agg(*aggs), trades, tuple(by), {ret: {"p5": 0.05}})
    s = Series(by, order)
    run = trades.withColumn("_c", s.cumulative(ret)).withColumn("_d", F.col("_c") - F.greatest(s.running_max("_c"), F.lit(0.0)))
    fall = -F.min("_d")
    return with_quantiles(run.groupBy(*by).agg(*aggs, fall.alias("max_fall"), (F.sum(ret) / F.nullif(fall, F.lit(0.0))).alias("calmar")), trades, tuple(by), {ret: {"p5": 0.05}})


def by_exit_reason(trades: DataFrame, reason: str = "exit_reason", ret: str = "return_pct") -> DataFrame:
    return trades.groupBy(reason).agg(F.count("*").alias("n"), F.avg(ret).alias("mean_return"), F.sum((F.col(ret) > 0).cast("bigint")).alias("wins"))


def overfit_gap(trades: DataFrame, cfg: str, split: str = "split", ret: str = "return_pct") -> DataFrame:
    """Win rate and profit factor by configuration on train and test, and their absolute gaps."""
    win, loss = F.sum(F.when(F.col(ret) > 0, F.col(ret))), -F.sum(F.when(F.col(ret) <= 0, F.col(ret)))
    wide = trades.groupBy(cfg).pivot(split, ["train", "test"]).agg(F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), (win / F.nullif(loss, F.lit(0.0))).alias("pf"))
    return wide.withColumns({"win_rate_gap": F.abs(F.col("train_win_rate") - F.col("test_win_rate")), "pf_gap": F.abs(F.col("train_pf") - F.col("test_pf"))})


def ops_report(trades: DataFrame, exit_time: str, pnl: str, now: Column, errors: DataFrame | None = None, error_ts: str = "ts") -> DataFrame:
    """One row: closed and open trades, win rate, profit of the day of ``now``, errors in the hour before it."""
    closed = F.col(exit_time).isNotNull()
    today = F.to_date(F.col(exit_time)) == F.to_date(now)
    out = trades.agg(F.sum(closed.cast("bigint")).alias("closed"), F.sum((~closed).cast("bigint")).alias("open"), F.avg(F.when(closed, (F.col(pnl) > 0).cast("double"))).alias("win_rate"), F.coalesce(F.sum(F.when(today, F.col(pnl))), F.lit(0.0)).alias("pnl_today"))
    if errors is None:
        return out
    recent = errors.where((F.col(error_ts) <= now) & (F.col(error_ts) > now - F.expr("INTERVAL 1 HOUR"))).agg(F.count("*").alias("errors_1h"))
    return out.crossJoin(recent)  # one row each


def equity(trades: DataFrame, positions: DataFrame, initial: float, pnl: str, cost: str) -> DataFrame:
    """One row: capital = initial + closed profit - money in open positions, and equity with the positions at cost."""
    made = trades.agg(F.coalesce(F.sum(pnl), F.lit(0.0)).alias("pnl"))
    held = positions.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("held"))
    return made.crossJoin(held).select("pnl", "held", (F.lit(initial) + F.col("pnl") - F.col("held")).alias("capital"), (F.lit(initial) + F.col("pnl")).alias("equity"))


# --- groups -----------------------------------------------------------------------------------------


def group_profile(df: DataFrame, by: str, cols: list[str], cond: Column, name: str = "share") -> DataFrame:
    """Count, median, quartiles, min and max of each column, and the share of rows with a condition."""
    aggs = [x for c in cols for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    out = df.groupBy(by).agg(F.count("*").alias("n"), *aggs, F.avg(cond.cast("double")).alias(name))
    return with_quantiles(out, df, (by,), {c: {f"{c}_q25": 0.25, f"{c}_median": 0.5, f"{c}_q75": 0.75} for c in cols})


def purity(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """max(0, 1 - mean coefficient of variation of the positive values) of each group."""
    cv = [F.stddev_pop(F.when(F.col(c) > 0, F.col(c))) / F.avg(F.when(F.col(c) > 0, F.col(c))) for c in cols]
    known = F.array_compact(F.array(*[F.col(f"_c{i}") for i in range(len(cols))]))
    g = df.groupBy(by).agg(*[x.alias(f"_c{i}") for i, x in enumerate(cv)])
    mean = F.aggregate(known, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return g.select(by, F.greatest(F.lit(0.0), 1 - mean).alias("purity"))


def group_score(df: DataFrame, by: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of log10(max(median, 1)) by group."""
    total = sum((F.lit(w) * F.log10(F.greatest(F.col(f"_m_{c}"), F.lit(1.0))) for c, w in weights.items()), F.lit(0.0))
    return with_quantiles(df.groupBy(by).agg(F.count("*").alias("n")), df, (by,), {c: {f"_m_{c}": 0.5} for c in weights}).select(by, "n", total.alias("score"))


def group_outcomes(points: DataFrame, by: str, vector: str, outcome: str) -> DataFrame:
    """Count, median and mean outcome, win rate, centroid and population deviation of the distance to it, by group."""
    dims = points.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    centre = dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))  # one entry for each dimension
    far = F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda a, x: a + x))
    out = points.join(centre, by).groupBy(by, "centroid").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"), F.avg((F.col(outcome) > 0).cast("double")).alias("win_rate"), F.stddev_pop(far).alias("radius_std"))
    return with_quantiles(out, points, (by,), {outcome: {"median_outcome": 0.5}})


def envelope(df: DataFrame, by: str, step: str, v: str) -> DataFrame:
    """Median, quartiles and number of series alive at each step of each group."""
    alive = df.groupBy(by, step).agg(F.count("*").alias("alive"))
    q = exact_percentiles(df, v, {"q25": 0.25, "median": 0.5, "q75": 0.75}, (by, step)).withColumnsRenamed({by: "_by", step: "_step"})
    return alive.join(q, F.col(by).eqNullSafe(F.col("_by")) & F.col(step).eqNullSafe(F.col("_step")), "left").select(by, step, "q25", "median", "q75", "alive")


def phase_summary(df: DataFrame, key: str, group: str, ts: str, v: str, holders: str) -> DataFrame:
    """By group, medians over keys of: hours to the peak, holder growth up to it, hours after it, value kept at the end."""
    w = Window.partitionBy(key)
    peak = F.min(F.struct((-F.col(v)).alias("v"), F.col(ts).alias("t"))).over(w)["t"]
    x = df.withColumn("_p", peak)
    k = x.groupBy(key, group).agg(((epoch(F.max("_p")) - epoch(F.min(ts))) / 3600).alias("to_peak"), ((epoch(F.max(ts)) - epoch(F.max("_p"))) / 3600).alias("after"), (F.max_by(v, ts) / F.nullif(F.max(v), F.lit(0.0))).alias("kept"), (F.max(F.when(F.col(ts) == F.col("_p"), F.col(holders))) / F.greatest(F.min_by(holders, ts), F.lit(1))).alias("growth"))
    k = written_once(k)
    return with_quantiles(k.groupBy(group).agg(F.count("*").alias("keys")), k, (group,), {c: {c: 0.5} for c in ("to_peak", "growth", "after", "kept")})


def quality_report(fine: DataFrame, by: str, ts: str, step_seconds: float, gap_seconds: float = 1800, good: float = 0.95, fair: float = 0.7) -> DataFrame:
    """By key: rows, coverage of the grid in percent, largest gap and gaps over the limit, status (empty of gaps and
    covered: good; fair; poor)."""
    s = Series(by, ts)
    gap = epoch(ts) - epoch(s.lag(ts))
    g = fine.withColumn("_g", gap).groupBy(by).agg(F.count("*").alias("rows"), F.min(epoch(ts)).alias("a"), F.max(epoch(ts)).alias("b"), F.max("_g").alias("g"), F.sum((F.col("_g") > gap_seconds).cast("bigint")).alias("n_gaps"))
    cover = F.least(F.col("rows") / (F.floor((F.col("b") - F.col("a")) / step_seconds) + 1), F.lit(1.0))
    rules = [("good", (cover >= good) & (F.coalesce("n_gaps", F.lit(0)) == 0)), ("fair", cover >= fair)]
    return g.select(by, "rows", (cover * 100).alias("coverage_pct"), F.coalesce(F.col("g") / 60, F.lit(0.0)).alias("max_gap_min"), F.coalesce("n_gaps", F.lit(0)).cast("bigint").alias("n_gaps"), first_reason(rules, "poor").alias("status"))


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def n_distinct(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(key) if approximate else F.countDistinct(key)).alias("n"))


def thresholds(df: DataFrame, c: str, ps: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row with the exact quantiles (linear interpolation)."""
    return exact_percentiles(df, c, {f"p{round(p * 100)}": p for p in ps})


def extents(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


# --- totals along an order -------------------------------------------------------------------------


RANGE_ROWS = 1 << 20  # distinct values of a range


def written_once(df: DataFrame) -> DataFrame:
    """``df`` from the shared checkpoint folder if the session has one, so that several passes do not repeat its plan; otherwise
    ``df`` itself. (spark.cleaner.referenceTracking.cleanCheckpoints has Spark delete the files.)"""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def range_cuts(df: DataFrame, c: str, parts: int = 64) -> list[float]:
    """Approximate quantiles that cut the numbers ``c`` into about ``parts`` ranges."""
    return sorted(set(df.approxQuantile(c, [i / parts for i in range(1, parts)], 0.002)))


def in_ranges(df: DataFrame, c: str, cuts: list[float]) -> DataFrame:
    """Adds ``_range``: how many of the cuts are smaller (0 for nulls)."""
    return df.withColumn("_range", F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(c))) if cuts else F.lit(0))


def running_totals(df: DataFrame, c: str, sums: dict[str, str], by: tuple[str, ...] = (), cuts: list[float] | None = None, inclusive: bool = False) -> DataFrame:
    """Adds for each entry (name: column) of ``sums`` the column's sum over the rows of the group ``by`` with a smaller number ``c``
    (``inclusive``: and of this row; nulls first); values of ``c`` are distinct in a group.

    Rows are cut into ranges of ``c``; sums run inside a range, in parallel, and start from the totals of the ranges before (a row for
    each group and range). The cuts decide only who works, not the result.
    """
    ranged = in_ranges(df, c, range_cuts(df, c) if cuts is None else cuts)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_s_{name}") for name, n in sums.items()])
    before = totals.select(*[F.col(k).alias(f"_k_{k}") for k in (*by, "_range")], *[F.sum(f"_s_{name}").over(earlier).alias(f"_b_{name}") for name in sums])
    upto = Window.partitionBy(*by, "_range").orderBy(c).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = ranged.withColumns({f"_o_{name}": F.sum(n).over(upto) for name, n in sums.items()})
    met = F.col("_range") == F.col("_k__range")
    for k in by:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = own.join(before if by else F.broadcast(before), met)  # without groups: a row for each range
    return joined.select(*df.columns, *[(F.coalesce(f"_b_{name}", F.lit(0)) + F.coalesce(f"_o_{name}", F.lit(0))).alias(name) for name in sums])


def running_total(df: DataFrame, c: str, n: str, name: str) -> DataFrame:
    """``running_totals`` of one column over all rows."""
    return running_totals(df, c, {name: n})


def exact_percentiles(df: DataFrame, c: str, names: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation, nulls left out) of each group, or one row without groups, from the counts of distinct
    values and their running totals: no task holds a group's values."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = written_once(counts)
    parts = min(1024, -(-counts.count() // RANGE_ROWS))
    placed = running_totals(counts, "_v", {"_below": "_n"}, by, range_cuts(counts, "_v", parts) if parts > 1 else [])
    all_rows = counts.groupBy(*[F.col(k).alias(f"_g_{k}") for k in by]).agg(F.sum("_n").alias("_all"))
    met = None
    for k in by:
        one = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        met = one if met is None else met & one
    known = placed.join(all_rows, met) if by else placed.crossJoin(F.broadcast(all_rows))  # without groups: one row

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("_below") <= i) & (i < F.col("_below") + F.col("_n")), F.col("_v")))

    def quantile(q: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(q)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        return low + part * (F.coalesce(at(F.floor(place) + 1), low) - low)

    return known.groupBy(*by).agg(*[quantile(q).alias(name) for name, q in names.items()])


def with_quantiles(out: DataFrame, df: DataFrame, by: tuple[str, ...], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Adds exact quantiles of columns of ``df`` (column: name: quantile) to ``out``, a row for each group (or one row)."""
    for c, names in wanted.items():
        q = exact_percentiles(df, c, names, by).withColumnsRenamed({k: f"_q_{k}" for k in by})
        met = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in by]
        out = out.join(q, met, "left").drop(*[f"_q_{k}" for k in by]) if by else out.crossJoin(F.broadcast(q))  # without groups: one row
    return out


# --- regression and survival ------------------------------------------------------------------------


def poly2_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares y = c0 + c1 x + c2 x^2 by group from power sums, with R2, residual deviation and linear R2.

    x is centred on its group mean first (a window over the group), which keeps the normal equations well
    conditioned; coefficients are for the centred x, whose mean is returned as ``x_mean``.
    """
    w = Window.partitionBy(*by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_m", F.avg(x).over(w)).withColumn("_x", F.col(x) - F.col("_m"))
    p = lambda i, j: F.sum(F.pow("_x", F.lit(float(i))) * F.pow(y, F.lit(float(j)))).alias(f"s{i}{j}")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.max("_m").alias("x_mean"), *[p(i, 0) for i in range(1, 5)], *[p(i, 1) for i in range(3)], p(0, 2), F.regr_r2(y, x).alias("r2_linear"))
    n, s1, s2, s3, s4 = (F.col(c).cast("double") for c in ("n", "s10", "s20", "s30", "s40"))
    t0, t1, t2 = F.col("s01"), F.col("s11"), F.col("s21")
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    det = F.when(F.abs(det) > 1e-12, det)
    c0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det
    c1 = (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det
    c2 = (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det
    fit = g.withColumns({"c0": c0, "c1": c1, "c2": c2})
    sse = F.greatest(F.col("s02") - F.col("c0") * t0 - F.col("c1") * t1 - F.col("c2") * t2, F.lit(0.0))
    sst = F.col("s02") - t0 * t0 / n
    return fit.select(*by, "n", "x_mean", "c0", "c1", "c2", (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), F.sqrt(sse / n).alias("sigma"), "r2_linear")


def kaplan_meier(episodes: DataFrame, duration: str = "duration", observed: str = "observed") -> DataFrame:
    """(duration, events, at_risk, survival, hazard): one row for each distinct duration; censored episodes leave the
    risk set without an event. Totals over durations run in ranges of them."""
    g = episodes.groupBy(duration).agg(F.sum(F.col(observed).cast("bigint")).alias("events"), F.count("*").alias("_left"))
    g = written_once(g)
    cuts = range_cuts(g, duration)
    size = g.agg(F.sum("_left").alias("_size"))  # one row
    x = running_totals(g, duration, {"_gone": "_left"}, cuts=cuts).crossJoin(F.broadcast(size)).withColumn("at_risk", F.col("_size") - F.col("_gone"))
    x = x.withColumn("hazard", F.col("events") / F.col("at_risk")).withColumn("_log", F.when(F.col("hazard") < 1, F.log1p(-F.col("hazard"))).otherwise(0.0))
    survived = F.when(F.col("hazard") >= 1, 0.0).otherwise(F.exp("_sum"))  # a hazard of 1 takes all that is left, so no duration follows it
    return running_totals(x, duration, {"_sum": "_log"}, cuts=cuts, inclusive=True).select(duration, "events", "at_risk", survived.alias("survival"), "hazard")


def survival_at(curve: DataFrame, ages: DataFrame, age: str, duration: str = "duration") -> DataFrame:
    """Survival and hazard of the last step at or below each age (1 and 0 before the first and for null ages).

    Distinct ages and steps are put in one order, cut into ranges, and each age takes the last step of its range or else of the
    ranges before; rows meet their age by equality.
    """
    steps = curve.select(F.col(duration).cast("double").alias("_at"), F.struct("survival", "hazard").alias("_step"))
    asked = ages.select(F.col(age).cast("double").alias("_at")).distinct()
    line = steps.unionByName(asked, allowMissingColumns=True).where("_at is not null").groupBy("_at").agg(F.max("_step").alias("_step"))
    line = written_once(line)
    ranged = in_ranges(line, "_at", range_cuts(line, "_at"))
    ends = ranged.groupBy("_range").agg(F.max_by("_step", F.when(F.col("_step").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_range", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))  # a row for each range
    own = F.last("_step", ignorenulls=True).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("_own", own).join(F.broadcast(before), "_range").select("_at", F.coalesce("_own", "_before").alias("_step"))
    return ages.join(found, F.col(age).cast("double") == F.col("_at"), "left").select(*ages.columns, F.coalesce("_step.survival", F.lit(1.0)).alias("survival"), F.coalesce("_step.hazard", F.lit(0.0)).alias("hazard"))


def median_survival(curve: DataFrame, duration: str = "duration") -> DataFrame:
    return curve.where("survival <= 0.5").agg(F.min(duration).alias("median_survival"))


# --- model reports ----------------------------------------------------------------------------------


def attribution(sample: DataFrame, key: str, cols: list[str], importance: dict[str, float]) -> DataFrame:
    """Relative deviation of each feature from its median times the feature's importance, ranked within a row."""
    med = with_quantiles(sample.agg(F.count("*").alias("_rows")), sample, (), {c: {f"_m_{c}": 0.5} for c in cols})
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.abs(F.col(f"_m_{c}")), F.lit(1e-9)) * importance[c]).alias("effect")) for c in cols])
    long = sample.crossJoin(F.broadcast(med)).select(key, F.explode(parts).alias("_p")).select(key, "_p.feature", "_p.effect")  # med is one row
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("effect")), "feature")
    return long.withColumn("rank", F.row_number().over(w))


def precision_at_k(df: DataFrame, key: str, score: str, hit: str, outcome: str, ks: list[int]) -> DataFrame:
    """Precision and mean outcome of the k best rows and of the k worst, for several k.

    Only the max(ks) best and worst rows are ranked (a top-k sort, not a full one).
    """
    top = max(ks)

    def ranked(order: list[Column]) -> DataFrame:
        best = df.select(key, score, hit, outcome).orderBy(*order).limit(top)
        return best.withColumn("r", F.row_number().over(Window.orderBy(*order)))

    cuts = F.array(*[F.lit(k) for k in ks])
    good = ranked([F.desc(score), F.col(key)]).withColumn("k", F.explode(cuts)).where("r <= k").groupBy("k").agg(F.avg(F.col(hit).cast("double")).alias("precision"), F.avg(outcome).alias("mean_outcome"))
    bad = ranked([F.col(score), F.col(key)]).withColumn("k", F.explode(cuts)).where("r <= k").groupBy("k").agg(F.avg(F.col(hit).cast("double")).alias("bottom_precision"))
    return good.join(bad, "k")


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Support, predicted, precision, recall and F1 of each class that occurs as label or prediction."""
    cells = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("as_label"), F.lit(0).alias("as_pred")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("as_label"), F.lit(1).alias("as_pred")))).alias("_x"), "n", (F.col(label) == F.col(pred)).alias("right")).select("_x.*", "n", "right")
    g = long.groupBy("class").agg(F.sum(F.col("as_label") * F.col("n")).alias("support"), F.sum(F.col("as_pred") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("right") & (F.col("as_label") == 1), F.col("n")).otherwise(0)).alias("tp"))
    p, r = F.col("tp") / F.nullif(F.col("predicted"), F.lit(0)), F.col("tp") / F.nullif(F.col("support"), F.lit(0))
    return g.select("class", "support", "predicted", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def mean_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """Rank with ties averaged."""
    counts = running_total(written_once(df.groupBy(c).agg(F.count("*").alias("_n"))), c, "_n", "_below")
    return df.join(counts.select(c, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name)), c)


def regression_report(df: DataFrame, actual: str, pred: str, strong: float) -> DataFrame:
    """One row: Spearman correlation, mean absolute error, share of right directions, mean outcome of predictions
    of at least ``strong``."""
    x = mean_rank(mean_rank(written_once(df.select(actual, pred)), actual, "ra"), pred, "rp")
    return x.agg(F.count("*").alias("n"), correlation("ra", "rp").alias("spearman"), F.avg(F.abs(F.col(actual) - F.col(pred))).alias("mae"), F.avg((F.signum(actual) == F.signum(pred)).cast("double")).alias("direction"), F.avg(F.when(F.col(pred) >= strong, F.col(actual))).alias("strong_mean"))


def threshold_sweep(df: DataFrame, score: str, cuts: list[float], ret: str = "return_pct") -> DataFrame:
    """Trade statistics of the rows at or above each cut."""
    reached = F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(score))
    return df.withColumn("cut", F.explode(reached)).groupBy("cut").agg(F.count("*").alias("n"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), F.avg(ret).alias("mean_return"), (F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0))).alias("sharpe"), F.min(ret).alias("worst"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve by the rank-sum formula, accuracy at 0.5, base rate."""
    x = mean_rank(df.select(score, label), score, "_r")
    pos, n = F.sum(F.col(label).cast("double")), F.count("*").cast("double")
    area = (F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))
    return x.agg(area.alias("auc"), F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"), F.avg(F.col(label).cast("double")).alias("base_rate"))


def scam_score(rows: DataFrame, by: str, swap: Column, other: Column, big_in: Column, growth: Column, min_swap_share: float, max_big_share: float, min_positive: float) -> DataFrame:
    """Acquisition mix of a key with the reasons why it fails."""
    g = rows.groupBy(by).agg(F.sum(swap).alias("swaps"), F.sum(other).alias("others"), F.sum(big_in).alias("big"), F.avg((growth > 0).cast("double")).alias("positive_share"))
    x = g.withColumn("swap_share", F.coalesce(ratio("swaps", F.col("swaps") + F.col("others")), F.lit(0.0))).withColumn("big_share", F.coalesce(ratio("big", F.col("swaps") + F.col("others")), F.lit(0.0)))
    return x.withColumn("reasons", F.concat_ws("; ", F.when(F.col("swap_share") < min_swap_share, "few swaps"), F.when(F.col("big_share") > max_big_share, "big holders"), F.when(F.col("positive_share") < min_positive, "rarely growing"))).withColumn("ok", F.col("reasons") == "")


def funnel_counts(scans: DataFrame, id_col: str, layers: list[str], n: int = 20) -> DataFrame:
    """One row: mean of each layer's count over the last n scans."""
    return scans.orderBy(F.desc(id_col)).limit(n).agg(F.count("*").alias("scans"), *[F.avg(c).alias(c) for c in layers])


def trade_flags(trades: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return trades.withColumn("flags", tags(rules))


def flag_counts(flagged: DataFrame, n: int = 10) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(n)
