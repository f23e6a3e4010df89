"""The four workloads as jobs on bars of keyed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import forward_label, ratio
from ..functions.windows import Series
from ..kernels import trades as R
from ..operators import clean, cluster, features, kernels, ml, scoring, stats, topk


def scan_labels(bars: DataFrame, by: str, ts: str, v: str, threshold: float, min_value: float, min_gain: float, up: float = 2.0, down: float = 0.5, horizon: int = 48) -> DataFrame:
    """Minimum slice: bars from the first crossing on, growth over 4 rows, drawdown, extremes of the next rows, the
    scan predicate, and the label's count and mean forward multiple for each key."""
    s = Series(by, ts)
    x = clean.trim_from_crossing(bars, by, ts, v, threshold)
    x = x.withColumns({"roc4": s.roc(v, 4), "drawdown": s.drawdown(v), "up": ratio(s.future_extreme(v, horizon, "max", True), v), "down": ratio(s.future_extreme(v, horizon, "min", True), v)})
    hit = x.where((F.col(v) >= min_value) & (F.col("roc4") >= min_gain) & F.col("up").isNotNull())
    return hit.withColumn("label", forward_label("up", "down", up, down)).groupBy(by, "label").agg(F.count("*").alias("n"), F.avg("up").alias("mean_multiple"), F.avg("drawdown").alias("mean_drawdown"))


FEATURES = ["return", "range", "return_6h", "return_half", "volatility", "mean_return", "max_drawdown", "momentum_shift", "peak_position", "volume_trend", "volume_concentration"]
HISTORY = ["h_rows", "h_age_hours", "h_return", "h_of_peak"]


def early_warning(bars: DataFrame, by: str, ts: str, v: str, volume: str, threshold: float, up: float, down: float, folds: int = 3, **how) -> DataFrame:
    """W1: window samples, out-of-fold predicted multiple (whole keys held out), grade by quantiles of the prediction."""
    samples = features.window_samples(bars, by, ts, v, volume, threshold, up=up, down=down).fillna(0.0, FEATURES + HISTORY)
    folded = ml.hashed_folds(samples.withColumn("h_rows", F.col("h_rows").cast("double")), by, folds)
    scored = ml.train_forward_multiple(folded, FEATURES, HISTORY, "max_multiple", folds=folds, **how)
    return scoring.graded(scored, "pred", stats.thresholds(scored, "pred"))


def backtest(bars: DataFrame, by: str, ts: str, v: str, buy: Column, configs: dict[str, tuple[float, int]]) -> DataFrame:
    """W2: entries on a signal, exits by trailing stop and time, for a grid of (stop, rows); statistics by configuration."""
    rows = bars.withColumn("_buy", F.coalesce(buy, F.lit(False)))

    def run(a: dict, c: tuple[float, int]) -> list[dict]:
        return R.positions(a[v].astype(float), a["_buy"].astype(bool), [R.trailing(c[0]), ("time_stop", lambda p: p.bars >= c[1])])

    return stats.trade_stats(kernels.sweep(rows, by, [ts], [v, "_buy"], configs, run), ["cfg"], peak="peak_return_pct")


def lifecycle_candidates(bars: DataFrame, by: str, ts: str, v: str, volume: str, holders: str, threshold: float, k: int, keep_from: int, seed: int = 7) -> DataFrame:
    """W3: lifecycle features, K-means on logs ranked by median peak, regression residuals, the best candidates of the
    groups from ``keep_from`` on."""
    f = features.lifecycle_features(bars, by, ts, v, volume, holders, threshold)
    logs = f.select(by, *[F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) for c in ("rise_hours", "peak", "decay_hours", "volume_roc")])
    scaled = cluster.apply_scaler(logs, cluster.fit_scaler(logs, ["rise_hours", "peak", "decay_hours", "volume_roc"]), ["rise_hours", "peak", "decay_hours", "volume_roc"])
    grouped, _ = cluster.fit_kmeans(scaled, [f"{c}_s" for c in ("rise_hours", "peak", "decay_hours", "volume_roc")], k, seed, "peak")
    fits = stats.poly2_fit(logs.withColumn("pair", F.lit("rise_hours~peak")), "rise_hours", "peak", ["pair"])
    scored = scoring.residual_scores(grouped.where(F.col("cluster") >= keep_from).select(by, "rise_hours", "peak", "cluster"), fits, [("rise_hours", "peak", 1.0)], by)
    return topk.leaderboard(scored, "composite", by, 50)


def funnel(bars: DataFrame, by: str, order: list[str], v: str, volume: str, holders: str, idx: str, min_value: float, min_gain: float, threshold: float, **how) -> DataFrame:
    """W4: scan and scam filters give candidates, a class-balanced tree model scores them out of fold, the funnel kernel
    trades the scored rows with drawdown actions; risk statistics overall. Statistics read the trades twice, so their returns are written once."""
    s = Series(by, order)
    x = features.funnel_features(bars, s, v, volume, idx).withColumn("y", F.coalesce(ratio(s.future_extreme(v, 12, "max", True), v) >= 1.5, F.lit(False)).cast("int"))
    cand = x.where((F.col(v) >= min_value) & (F.col("roc_6") >= min_gain))
    cols = ["roc_1", "roc_3", "roc_6", "roc_12", "accel_3", "vwap_gap", "vwap_slope", "std_12", "volume_trend", "drawdown"]
    scored = ml.train_binary(ml.hashed_folds(cand, by, 3), cols, "y", folds=3, **how).select(by, idx, "p")
    joined = x.join(scored, [by, idx], "left").withColumns({"cand": F.col("p").isNotNull(), "score": F.coalesce("p", F.lit(0.0)), "act": F.when(F.col("drawdown") < -0.5, "SL_25").otherwise("HOLD")})
    trades = kernels.simulate_funnel(joined, by, order, v, "cand", "score", "act", threshold)
    return stats.risk_stats(stats.written_once(trades.select("ret")).withColumn("g", F.lit("all")), ["g"], "ret")
