"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch, hash_split
from ..operators import bars as B
from ..operators import cluster as K
from ..operators import features as X
from ..operators import scoring as G
from ..operators import stats as A
from . import query
from .clean import LIFE, PEAK, SPLIT
from .views import BARS_H, BARS_U, TICKS, TRADES, U, bars_h, bars_u, table, ticks, trades

STATS = """count(*) AS n, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(return_pct) AS mean_return, quantile_cont(return_pct, 0.5) AS median_return, coalesce(sum(return_pct) FILTER (return_pct > 0), 0) AS gross_profit,
coalesce(-sum(return_pct) FILTER (return_pct <= 0), 0) AS gross_loss, sum(return_pct) FILTER (return_pct > 0) / nullif(-sum(return_pct) FILTER (return_pct <= 0), 0) AS profit_factor, avg(return_pct) FILTER (return_pct > 0) AS mean_win,
avg(return_pct) FILTER (return_pct <= 0) AS mean_loss, avg(return_pct) FILTER (return_pct > 0) / nullif(-avg(return_pct) FILTER (return_pct <= 0), 0) AS win_loss_ratio, avg(bars_held) AS mean_hold, sum(return_pct) AS total_return"""
STAT_FLOATS = "win_rate mean_return median_return gross_profit gross_loss profit_factor mean_win mean_loss win_loss_ratio mean_hold total_return"


@query(f"""WITH {TICKS} SELECT k, CAST(floor(t / 21600) * 21600 AS BIGINT) AS bucket, first(v ORDER BY ts, id) AS open, max(v) AS high, min(v) AS low, last(v ORDER BY ts, id) AS close, count(*) AS n, sum(vol) AS vol FROM ticks GROUP BY ALL""", "open high low close vol")
def ag1_resample_bars(spark, d):
    return B.resample_bars(ticks(spark, d), "k", "ts", "v", 21600, "id", {"vol": F.col("vol")}).withColumn("bucket", F.unix_timestamp("bucket"))


@query(f"""WITH {TICKS}, b AS (SELECT k, CAST(floor(t / 21600) AS BIGINT) AS g, last(v ORDER BY ts, id) AS v FROM ticks GROUP BY ALL), e AS (SELECT k, min(g) AS a, max(g) AS z FROM b GROUP BY k),
grid AS (SELECT k, unnest(range(a, z + 1)) AS g FROM e)
SELECT k, g * 21600 AS bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY g) AS v FROM grid LEFT JOIN b USING (k, g)""", "v")
def ag2_resample_ffill(spark, d):
    return B.resample_ffill(ticks(spark, d), "k", "ts", "v", 21600, "id").withColumn("bucket", F.unix_timestamp("bucket"))


@query(f"""WITH {BARS_U} SELECT k, count(*) AS rows, min_by(v, ts) AS start_value, max(v) AS peak_value, (first(t ORDER BY v DESC, ts) - min(t)) / 3600 AS peak_hour, first(h ORDER BY v DESC, ts) AS h_at_peak FROM bars_u GROUP BY k""", "start_value peak_value peak_hour")
def ag3_trajectory_metadata(spark, d):
    return B.trajectory_metadata(bars_u(spark, d), "k", "ts", "v", ["h"])


@query(f"""WITH {BARS_U}, {PEAK}, g AS (SELECT k, max(v) AS peak, max(h) AS mh, min_by(v, ts) AS v0, min_by(h, ts) AS h0, max(h) FILTER (ts = p) AS hp, max_by(h, ts) AS h1, sum(vol) FILTER (ts <= p) AS vs, greatest((epoch_us(max(p)) - epoch_us(min(ts))) / 3.6e9, 1) AS up,
greatest((epoch_us(max(ts)) - epoch_us(max(p))) / 3.6e9, 1) AS dn, count(*) FILTER (ts > p) AS na FROM bars_u JOIN pk USING (k) GROUP BY k)
SELECT k, peak, (peak - v0) / up AS price_roc, vs / up AS volume_roc, (hp - h0) / up AS holder_roc, CASE WHEN na > 0 THEN (h1 - hp) / dn ELSE 0 END AS holder_decay_roc, mh AS max_holders FROM g""", "peak price_roc volume_roc holder_roc holder_decay_roc")
def ag4_outcome_features(spark, d):
    return X.outcome_features(bars_u(spark, d), "k", "ts", "v", "vol", "h")


@query(f"""WITH {LIFE}, g AS (SELECT k, max(peak) AS peak, min_by(v, ts) AS v0, max_by(v, ts) AS v1, min_by(h, ts) AS h0, max_by(h, ts) AS h1, max(h) FILTER (ts = p) AS hp, max(h) AS mh, sum(vol) FILTER (ts <= p) AS vs,
(epoch_us(max(p)) - epoch_us(max(t0))) / 3.6e9 AS up, (epoch_us(max(e)) - epoch_us(max(p))) / 3.6e9 AS dn FROM life GROUP BY k)
SELECT k, up AS rise_hours, (peak - v0) / greatest(up, 1) AS price_roc, vs / greatest(up, 1) AS volume_roc, (hp - h0) / greatest(up, 1) AS holder_roc, peak, hp AS holders_at_peak, dn AS decay_hours, (h1 - hp) / greatest(dn, 1) AS holder_decay_roc,
(v1 - peak) / greatest(dn, 1) AS price_decay_roc, up + dn AS total_hours, coalesce(up / nullif(up + dn, 0), 0) AS rise_share, mh AS max_holders, v1 AS last_value FROM g""", "rise_hours price_roc volume_roc holder_roc peak decay_hours holder_decay_roc price_decay_roc total_hours rise_share last_value")
def ag5_lifecycle_features(spark, d):
    return X.lifecycle_features(bars_u(spark, d), "k", "ts", "v", "vol", "h", 30, 0.3)


@query(f"""WITH {BARS_U}, {PEAK}, g AS (SELECT k, max(v) AS p0, min_by(v, ts) AS a, max_by(v, ts) AS z, greatest((epoch_us(max(p)) - epoch_us(min(ts))) / 3.6e9, 1) AS up, greatest((epoch_us(max(ts)) - epoch_us(max(p))) / 3.6e9, 1) AS dn FROM bars_u JOIN pk USING (k) GROUP BY k)
SELECT k, p0 / greatest(a, 1) AS rise_multiple, p0 / greatest(a, 1) / up AS rise_speed, z / p0 AS retention, (1 - z / p0) / dn AS decay_speed FROM g""", "rise_multiple rise_speed retention decay_speed")
def ag6_outcome_speeds(spark, d):
    return X.outcome_speeds(bars_u(spark, d), "k", "ts", "v")


@query(f"WITH {TRADES} SELECT k, {STATS} FROM trades GROUP BY k", STAT_FLOATS)
def ag11_trade_stats(spark, d):
    return A.trade_stats(trades(spark, d), ["k"])


@query(f"""WITH {TRADES}, c AS (SELECT *, sum(return_pct) OVER w AS c FROM trades WINDOW w AS (PARTITION BY k ORDER BY ts, ord, line ROWS UNBOUNDED PRECEDING)),
f AS (SELECT k, max(m - c) AS fall FROM (SELECT k, c, greatest(max(c) OVER (PARTITION BY k ORDER BY ts, ord, line ROWS UNBOUNDED PRECEDING), 0) AS m FROM c) GROUP BY k),
g AS (SELECT k, count(*) AS n, avg(return_pct) / nullif(stddev_pop(return_pct), 0) AS s, min(return_pct) AS worst, quantile_cont(return_pct, 0.05) AS p5, sum(return_pct) AS tot FROM trades GROUP BY k)
SELECT k, n, s AS sharpe, s * sqrt(n) AS sharpe_n, s * sqrt(252) AS sharpe_year, worst, p5, fall AS max_fall, tot / nullif(fall, 0) AS calmar FROM g JOIN f USING (k)""", "sharpe sharpe_n sharpe_year worst p5 max_fall calmar")
def ag12_risk_stats(spark, d):
    return A.risk_stats(trades(spark, d), ["k"], order=["ts", "ord", "line"])


@query(f"WITH {TRADES} SELECT exit_reason, {STATS}, CAST(grouping(exit_reason) AS INT) AS overall FROM trades GROUP BY ROLLUP (exit_reason)", STAT_FLOATS)
def ag13_stats_rollup(spark, d):
    return A.stats_rollup(trades(spark, d), "exit_reason")


@query(f"WITH {TRADES} SELECT exit_reason, count(*) AS n, avg(return_pct) AS mean_return, count(*) FILTER (return_pct > 0) AS wins FROM trades GROUP BY 1", "mean_return")
def ag14_by_exit_reason(spark, d):
    return A.by_exit_reason(trades(spark, d))


@query(f"""WITH {TRADES}, s AS (SELECT *, CASE WHEN {SPLIT.replace('c_custkey', 'k')} < 60 THEN 'train' ELSE 'test' END AS split FROM trades), g AS (SELECT exit_reason, split, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS w, sum(return_pct) FILTER (return_pct > 0) / nullif(-sum(return_pct) FILTER (return_pct <= 0), 0) AS p FROM s GROUP BY ALL)
SELECT a.exit_reason, a.w AS train_win_rate, a.p AS train_pf, b.w AS test_win_rate, b.p AS test_pf, abs(a.w - b.w) AS win_rate_gap, abs(a.p - b.p) AS pf_gap FROM g a JOIN g b USING (exit_reason) WHERE a.split = 'train' AND b.split = 'test'""", "train_win_rate train_pf test_win_rate test_pf win_rate_gap pf_gap")
def ag15_overfit_gap(spark, d):
    return A.overfit_gap(trades(spark, d).withColumn("split", hash_split("k")), "exit_reason")


@query(f"""WITH {TRADES}, c AS (SELECT *, CASE WHEN exit_reason <> 'NO' THEN ts END AS x FROM trades) SELECT count(x) AS closed, count(*) - count(x) AS open, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FILTER (x IS NOT NULL) AS win_rate, coalesce(sum(pnl) FILTER (CAST(x AS DATE) = DATE '1995-03-15'), 0) AS pnl_today,
(SELECT count(*) FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 11:00:00') AS errors_1h FROM c""", "win_rate pnl_today")
def ag16_ops_report(spark, d):
    t = trades(spark, d).withColumn("x", F.when(F.col("exit_reason") != "NO", F.col("ts")))
    errors = ticks(spark, d).where("kind = 'error'")
    day = A.ops_report(t, "x", "pnl", F.lit("1995-03-15 12:00:00").cast("timestamp"))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    recent = errors.where((F.col("ts") <= now) & (F.col("ts") > now - F.expr("INTERVAL 1 HOUR"))).agg(F.count("*").alias("errors_1h"))
    return day.crossJoin(recent)  # one row each


@query(f"""WITH {TRADES} SELECT sum(pnl) AS pnl, (SELECT sum(price) FROM trades WHERE exit_reason = 'NO' AND bars_held > 49) AS held, 1e9 + sum(pnl) - (SELECT sum(price) FROM trades WHERE exit_reason = 'NO' AND bars_held > 49) AS capital, 1e9 + sum(pnl) AS equity FROM trades""", "pnl held capital equity", 2)
def ag17_equity(spark, d):
    t = trades(spark, d)
    return A.equity(t, t.where("exit_reason = 'NO' and bars_held > 49"), 1e9, "pnl", "price")


@query(f"""WITH {TICKS} SELECT kind, count(*) AS n, quantile_cont(v, 0.25) AS v_q25, quantile_cont(v, 0.5) AS v_median, quantile_cont(v, 0.75) AS v_q75, min(v) AS v_min, max(v) AS v_max, avg(CASE WHEN v > 100 THEN 1.0 ELSE 0.0 END) AS runners FROM ticks GROUP BY kind""", "v_q25 v_median v_q75 v_min v_max runners")
def ag18_group_profile(spark, d):
    return A.group_profile(ticks(spark, d), "kind", ["v"], F.col("v") > 100, "runners")


@query(f"""WITH {TICKS} SELECT kind, greatest(0, 1 - (stddev_pop(v) FILTER (v > 0) / avg(v) FILTER (v > 0) + stddev_pop(vol) FILTER (vol > 0) / avg(vol) FILTER (vol > 0)) / 2) AS purity FROM ticks GROUP BY kind""", "purity")
def ag19_purity(spark, d):
    return A.purity(ticks(spark, d), "kind", ["v", "vol"])


@query(f"""WITH {TICKS} SELECT kind, count(*) AS n, 0.7 * log10(greatest(quantile_cont(v, 0.5), 1)) + 0.3 * log10(greatest(quantile_cont(vol, 0.5), 1)) AS score FROM ticks GROUP BY kind""", "score")
def ag20_group_score(spark, d):
    return A.group_score(ticks(spark, d), "kind", {"v": 0.7, "vol": 0.3})


@query("""WITH p AS (SELECT label, embedding AS x, vec_id % 7 - 3 AS o FROM embeddings), c AS (SELECT label, i, avg(x[i]::DOUBLE) AS m FROM p, range(1, 65) r(i) GROUP BY ALL), cc AS (SELECT label, list(m ORDER BY i) AS c FROM c GROUP BY label),
q AS (SELECT label, o, sqrt(list_sum(list_transform(list_zip(x, c), lambda z: (z[1]::DOUBLE - z[2]) ** 2))) AS r FROM p JOIN cc USING (label))
SELECT label, count(*) AS n, quantile_cont(o, 0.5) AS median_outcome, avg(o) AS mean_outcome, avg(CASE WHEN o > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, stddev_pop(r) AS radius_std FROM q GROUP BY label""", "median_outcome mean_outcome win_rate radius_std")
def ag21_group_outcomes(spark, d):
    p = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 7 - 3).alias("o"))
    return A.group_outcomes(p, "label", "x", "o").drop("centroid")


@query(f"""WITH {BARS_U} SELECT k % 5 AS g, i, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, count(*) AS alive FROM bars_u GROUP BY ALL""", "q25 median q75")
def ag22_envelope(spark, d):
    return A.envelope(bars_u(spark, d).withColumn("g", F.col("k") % 5), "g", "i", "v")


@query(f"""WITH {BARS_U}, {PEAK}, q AS (SELECT k, k % 5 AS g, (epoch_us(max(p)) - epoch_us(min(ts))) / 3.6e9 AS a, (epoch_us(max(ts)) - epoch_us(max(p))) / 3.6e9 AS b, max_by(v, ts) / max(v) AS kept, max(h) FILTER (ts = p) / greatest(min_by(h, ts), 1) AS gr FROM bars_u JOIN pk USING (k) GROUP BY k)
SELECT g, count(*) AS keys, quantile_cont(a, 0.5) AS to_peak, quantile_cont(gr, 0.5) AS growth, quantile_cont(b, 0.5) AS after, quantile_cont(kept, 0.5) AS kept FROM q GROUP BY g""", "to_peak growth after kept")
def ag23_phase_summary(spark, d):
    return A.phase_summary(bars_u(spark, d).withColumn("g", F.col("k") % 5), "k", "g", "ts", "v", "h")


@query(f"""WITH {TICKS}, s AS (SELECT k, t, t - lag(t) OVER (PARTITION BY k ORDER BY ts, id) AS g FROM ticks), q AS (SELECT k, count(*) AS rows, least(count(*) / (floor((max(t) - min(t)) / 36000) + 1), 1) AS cv, coalesce(max(g) / 60, 0) AS mg, count(*) FILTER (g > 86400) AS ng FROM s GROUP BY k)
SELECT k, rows, cv * 100 AS coverage_pct, mg AS max_gap_min, ng AS n_gaps, CASE WHEN cv >= 0.95 AND ng = 0 THEN 'good' WHEN cv >= 0.9 THEN 'fair' ELSE 'poor' END AS status FROM q""", "coverage_pct max_gap_min")
def ag24_quality_report(spark, d):
    return A.quality_report(ticks(spark, d), "k", "ts", 36000, 86400, 0.95, 0.9)


@query(f"""WITH {BARS_U}, r AS (SELECT *, v / nullif(lag(v) OVER (PARTITION BY k ORDER BY ts), 0) - 1 AS r FROM bars_u), g AS (SELECT k, max(h) AS max_holders, min(r) AS worst, max(v) / greatest(min_by(v, ts), 1) AS multiple FROM r GROUP BY k)
SELECT *, CASE WHEN max_holders < 9 THEN 'scam' WHEN worst <= -0.999 THEN 'rug' WHEN multiple >= 8 THEN 'runner' ELSE 'mid' END AS label FROM g""", "worst multiple")
def ag25_outcome_label(spark, d):
    return X.outcome_label(bars_u(spark, d), "k", "ts", "v", "h", 9, 0.999, 8)


@query(f"WITH {TICKS} SELECT kind, CAST(vol AS INT) % 3 AS m, count(*) AS n, (SELECT count(DISTINCT k) FROM ticks) AS users FROM ticks GROUP BY 1, 2")
def ag26_value_counts(spark, d):
    t = ticks(spark, d)
    users = A.n_distinct(t, "k").withColumnRenamed("n", "users")  # one row
    return A.value_counts(t.withColumn("m", F.col("vol").cast("int") % 3), "kind", "m").crossJoin(users)


@query(f"WITH {TICKS} SELECT quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.8) AS p80, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM ticks", "p50 p80 p90 p95 p99")
def ag27_thresholds(spark, d):
    return A.thresholds(ticks(spark, d), "v")


@query(f"""WITH {BARS_H}, d AS (SELECT k, ln(1 + n) AS x0, ln(1 + c) AS y FROM bars_h), m AS (SELECT k, avg(x0) AS xm FROM d GROUP BY k), e AS (SELECT d.k, x0, x0 - xm AS x, y, xm FROM d JOIN m USING (k)),
s AS (SELECT k, max(xm) AS xm, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x**2) AS s2, sum(x**3) AS s3, sum(x**4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2, sum(y * y) AS yy, regr_r2(y, x0) AS r2l FROM e GROUP BY k),
q AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
f AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS c0, (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS c1,
(n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM q)
SELECT k, CAST(n AS BIGINT) AS n, xm AS x_mean, c0, c1, c2, 1 - (yy - c0 * t0 - c1 * t1 - c2 * t2) / nullif(yy - t0 * t0 / n, 0) AS r2, sqrt((yy - c0 * t0 - c1 * t1 - c2 * t2) / n) AS sigma, r2l AS r2_linear FROM f""", "x_mean c0 c1 c2 r2 sigma r2_linear")
def ag29_poly2_fit(spark, d):
    b = bars_h(spark, d).select("k", F.log1p("n").alias("x"), F.log1p("c").alias("y"))
    return A.poly2_fit(b, "x", "y", ["k"])


@query(f"""WITH {BARS_U}, m AS (SELECT quantile_cont(v, 0.5) AS mv, quantile_cont(vol, 0.5) AS mo, quantile_cont(h, 0.5) AS mh FROM bars_u),
e AS (SELECT id, unnest([{{'f': 'v', 'e': (v - mv) / greatest(abs(mv), 1e-9) * 0.5}}, {{'f': 'vol', 'e': (vol - mo) / greatest(abs(mo), 1e-9) * 0.3}}, {{'f': 'h', 'e': (h - mh) / greatest(abs(mh), 1e-9) * 0.2}}]) AS x FROM bars_u, m)
SELECT id, x.f AS feature, x.e AS effect, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(x.e) DESC, x.f) AS INT) AS rank FROM e""", "effect")
def ag30_attribution(spark, d):
    b = bars_u(spark, d)
    return A.attribution(b.select("id", "v", "vol", F.col("h").cast("double").alias("h")), "id", ["v", "vol", "h"], {"v": 0.5, "vol": 0.3, "h": 0.2})


@query(f"""WITH {TRADES}, g AS (SELECT CAST(bars_held AS INT) AS duration, count(*) FILTER (exit_reason <> 'NO') AS events, count(*) AS l FROM trades GROUP BY 1), r AS (SELECT *, sum(l) OVER (ORDER BY duration DESC) AS at_risk FROM g)
SELECT duration, events, CAST(at_risk AS BIGINT) AS at_risk, CASE WHEN max(events = at_risk) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival, events / at_risk AS hazard FROM r WINDOW w AS (ORDER BY duration)""", "survival hazard")
def ag31_kaplan_meier(spark, d):
    t = trades(spark, d).select(F.col("bars_held").cast("int").alias("duration"), (F.col("exit_reason") != "NO").alias("observed"))
    return A.kaplan_meier(t)


@query(f"""WITH {TRADES}, g AS (SELECT bars_held AS duration, count(*) FILTER (exit_reason <> 'NO') AS events, count(*) AS l FROM trades WHERE bars_held >= 5 GROUP BY 1), r AS (SELECT *, events / sum(l) OVER (ORDER BY duration DESC) AS hazard FROM g),
c AS (SELECT duration, CASE WHEN hazard >= 1 THEN 0 ELSE exp(sum(CASE WHEN hazard < 1 THEN ln(1 - hazard) ELSE 0 END) OVER (ORDER BY duration)) END AS survival, hazard FROM r), a AS (SELECT *, bars_held * 1.3 - 2 AS age FROM trades)
SELECT ord, line, coalesce(survival, 1) AS survival, coalesce(hazard, 0) AS hazard FROM a ASOF LEFT JOIN c ON a.age >= c.duration""", "survival hazard")
def ag31_survival_at(spark, d):
    """Survival and hazard of each trade at an age of its own, from the curve of the trades held for at least 5 bars."""
    t = trades(spark, d)
    curve = A.kaplan_meier(t.where("bars_held >= 5").select(F.col("bars_held").cast("double").alias("duration"), (F.col("exit_reason") != "NO").alias("observed")))
    return A.survival_at(curve, t.select("ord", "line", (F.col("bars_held") * 1.3 - 2).alias("age")), "age").select("ord", "line", "survival", "hazard")


@query(f"""WITH {BARS_U}, r AS (SELECT *, h - lag(h) OVER (PARTITION BY k ORDER BY ts, id) AS g FROM bars_u), q AS (SELECT k, sum(CASE WHEN kind = 'click' THEN vol ELSE 0 END) AS swaps, sum(CASE WHEN kind = 'view' THEN vol ELSE 0 END) AS others, sum(CASE WHEN v > 100 THEN vol ELSE 0 END) AS big, avg(CASE WHEN g > 0 THEN 1.0 WHEN g IS NULL THEN NULL ELSE 0.0 END) AS positive_share FROM r GROUP BY k),
z AS (SELECT *, coalesce(swaps / nullif(swaps + others, 0), 0) AS swap_share, coalesce(big / nullif(swaps + others, 0), 0) AS big_share FROM q)
SELECT *, concat_ws('; ', CASE WHEN swap_share < 0.45 THEN 'few swaps' END, CASE WHEN big_share > 0.35 THEN 'big holders' END, CASE WHEN positive_share < 0.2 THEN 'rarely growing' END) AS reasons, NOT (swap_share < 0.45 OR big_share > 0.35 OR positive_share < 0.2) AS ok FROM z""", "swaps others big positive_share swap_share big_share")
def ag32_scam_score(spark, d):
    b = bars_u(spark, d).withColumn("g", U.diff("h"))
    one = lambda cond: F.when(cond, F.col("vol")).otherwise(0.0)
    return A.scam_score(b, "k", one(F.col("kind") == "click"), one(F.col("kind") == "view"), one(F.col("v") > 100), F.col("g"), 0.45, 0.35, 0.2)


@query(f"""WITH {TRADES}, t AS (SELECT ord * 10 + line AS id, price, return_pct > 0 AS hit, return_pct FROM trades), a AS (SELECT *, row_number() OVER (ORDER BY price DESC, id) AS r, row_number() OVER (ORDER BY price, id) AS s FROM t)
SELECT k, avg(hit::INT) FILTER (r <= k) AS precision, avg(return_pct) FILTER (r <= k) AS mean_outcome, avg(hit::INT) FILTER (s <= k) AS bottom_precision FROM a, (VALUES (10), (100), (1000)) x(k) GROUP BY k""", "precision mean_outcome bottom_precision")
def ag33_precision_at_k(spark, d):
    t = trades(spark, d).select((F.col("ord") * 10 + F.col("line")).alias("id"), "price", (F.col("return_pct") > 0).alias("hit"), "return_pct")
    return A.precision_at_k(t, "id", "price", "hit", "return_pct", [10, 100, 1000])


@query(f"""WITH {TICKS}, c AS (SELECT kind AS y, CASE WHEN vol < 30 THEN 'click' WHEN vol < 60 THEN 'view' ELSE kind END AS p FROM ticks), k AS (SELECT y AS class FROM c UNION SELECT p FROM c),
g AS (SELECT class, (SELECT count(*) FROM c WHERE y = class) AS s, (SELECT count(*) FROM c WHERE p = class) AS q, (SELECT count(*) FROM c WHERE y = class AND p = class) AS tp FROM k)
SELECT class, s AS support, q AS predicted, coalesce(tp / nullif(q, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall, coalesce(2.0 * tp / nullif(s + q, 0), 0) AS f1 FROM g""", "precision recall f1")
def ag34_classification_report(spark, d):
    t = ticks(spark, d).withColumn("p", F.when(F.col("vol") < 30, "click").when(F.col("vol") < 60, "view").otherwise(F.col("kind")))
    return A.classification_report(t, "kind", "p")


@query(f"""WITH {TRADES}, t AS (SELECT round(return_pct, 6) AS a, round(return_pct + 4 * sin(line * k), 6) AS p FROM trades), r AS (SELECT a, p, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM t)
SELECT count(*) AS n, corr(ra, rp) AS spearman, avg(abs(a - p)) AS mae, avg(CASE WHEN sign(a) = sign(p) THEN 1.0 ELSE 0.0 END) AS direction, avg(a) FILTER (p >= 5) AS strong_mean FROM r""", "spearman mae direction strong_mean", 4)
def ag35_regression_report(spark, d):
    t = trades(spark, d).select(F.round("return_pct", 6).alias("a"), F.round(F.col("return_pct") + 4 * F.sin(F.col("line") * F.col("k")), 6).alias("p"))
    return A.regression_report(t, "a", "p", 5)


@query(f"""WITH {TRADES} SELECT cut, count(*) AS n, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(return_pct) AS mean_return, avg(return_pct) / nullif(stddev_pop(return_pct), 0) AS sharpe, min(return_pct) AS worst FROM trades JOIN (VALUES (0.0::DOUBLE), (20000.0), (60000.0), (90000.0)) x(cut) ON price >= cut GROUP BY cut""", "win_rate mean_return sharpe worst")
def ag36_threshold_sweep(spark, d):
    return A.threshold_sweep(trades(spark, d), "price", [0.0, 20000.0, 60000.0, 90000.0])


@query(f"""WITH {BARS_H}, s AS (SELECT CAST(t / 3600 AS BIGINT) AS scan, count(*) AS l0, count(*) FILTER (c > 30) AS l1, count(*) FILTER (c > 80) AS l2 FROM bars_h GROUP BY 1 ORDER BY 1 DESC LIMIT 20) SELECT count(*) AS scans, avg(l0) AS l0, avg(l1) AS l1, avg(l2) AS l2 FROM s""", "l0 l1 l2")
def ag37_funnel_counts(spark, d):
    scans = bars_h(spark, d).groupBy((F.unix_timestamp("ts") / 3600).cast("bigint").alias("scan")).agg(F.count("*").alias("l0"), F.count(F.when(F.col("c") > 30, 1)).alias("l1"), F.count(F.when(F.col("c") > 80, 1)).alias("l2"))
    return A.funnel_counts(scans, "scan", ["l0", "l1", "l2"])


@query(f"WITH {BARS_U} SELECT min(v) AS v_min, max(v) AS v_max, min(h) AS h_min, max(h) AS h_max FROM bars_u", "v_min v_max")
def ag38_extents(spark, d):
    return A.extents(bars_u(spark, d), ["v", "h"])


# --- scores and groups ------------------------------------------------------------------------------

CAND = """cand AS (SELECT k, CAST(t AS BIGINT) AS ts, c / nullif(lag(c, 4) OVER w, 0) - 1 AS chg, vol, avg(vol) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mv, buy, sell, (t - min(t) OVER (PARTITION BY k)) / 3600 AS age, c, max(c) OVER w AS pk FROM bars_h WINDOW w AS (PARTITION BY k ORDER BY ts))"""
SCORE = """SELECT k, ts, age, round(0.25 * m + 0.2 * s + 0.2 * p + 0.2 * f + 0.15 * hl, 4) AS score FROM (SELECT *, greatest(0, least(1, coalesce(chg, 0))) AS m, greatest(0, least(1, (coalesce(vol / nullif(mv, 0), 0) - 1) / 4)) AS s, coalesce(greatest(0, least(1, (coalesce(buy / nullif(buy + sell, 0), 0.4) - 0.4) / 0.3)), 0) AS p,
CASE WHEN age <= 2 THEN 1 WHEN age <= 12 THEN 1 - (age - 2) * 0.05 WHEN age <= 48 THEN 0.5 - (age - 12) * (0.5 / 36) ELSE 0 END AS f, coalesce(greatest(0, least(1, (c / pk - 0.2) / 0.8)) * CASE WHEN chg <= -0.5 THEN 0.5 ELSE 1 END, 0) AS hl FROM cand)"""


def candidates(spark, d):
    from .views import H

    return bars_h(spark, d).withColumns({"chg": H.roc("c", 4), "mv": F.avg("vol").over(H.frame(24)), "age": (epoch("ts") - F.min(epoch("ts")).over(H.all)) / 3600, "pk": H.running_max("c")})


def scored(spark, d):
    return G.entry_score(candidates(spark, d), "chg", "vol", "mv", "buy", "sell", "age", "c", "pk").select("k", F.unix_timestamp("ts").alias("ts"), "age", "score")


@query(f"WITH {BARS_H}, {CAND} {SCORE}", "age score", 4)
def sc6_entry_score(spark, d):
    return scored(spark, d)


@query(f"""WITH {BARS_H}, {CAND}, e AS ({SCORE}) SELECT k, ts, score, CAST(row_number() OVER (ORDER BY score DESC, k, ts) AS INT) AS rank FROM e QUALIFY rank <= 50""", "score", 4)
def tk7_leaderboard(spark, d):
    from ..operators.topk import leaderboard

    x = scored(spark, d).withColumn("key", F.concat_ws("|", "k", F.lpad(F.col("ts").cast("string"), 12, "0")))
    top = leaderboard(x, "score", "key", 50)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key"))).select("k", "ts", "score", "rank")  # 50 rows


@query(f"""WITH {BARS_H}, s AS (SELECT k, CAST(t AS BIGINT) AS ts, c / max(c) OVER w - 1 AS dd, n, lag(n) OVER w AS ln, c / avg(c) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - 1 AS g FROM bars_h WINDOW w AS (PARTITION BY k ORDER BY ts))
SELECT k, ts, least(1, CASE WHEN dd <= -0.3 THEN 0.3 ELSE 0 END + CASE WHEN n < coalesce(ln, n) THEN 0.2 ELSE 0 END + CASE WHEN n >= 3 THEN 0.15 ELSE 0 END + CASE WHEN g < -0.05 THEN 0.15 ELSE 0 END)::DOUBLE AS sell_pressure FROM s""", "sell_pressure")
def sc7_sell_pressure(spark, d):
    from .views import H

    x = bars_h(spark, d).withColumns({"dd": H.drawdown("c"), "ht": F.col("n") - F.coalesce(H.lag("n"), F.col("n")), "g": H.ma_deviation("c", 12), "vt": F.lit(0.0)})
    return G.sell_pressure(x, "dd", "vt", "ht", "n", "g").select("k", F.unix_timestamp("ts").alias("ts"), "sell_pressure")


@query(f"""WITH {TICKS}, q AS (SELECT quantile_cont(v, 0.8) AS p80, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM ticks) SELECT id, CASE WHEN v >= p99 THEN 'S' WHEN v >= p95 THEN 'A' WHEN v >= p90 THEN 'B' WHEN v >= p80 THEN 'C' ELSE 'D' END AS grade FROM ticks, q""")
def sc8_grade(spark, d):
    t = ticks(spark, d)
    return G.graded(t, "v", A.thresholds(t, "v")).select("id", "grade")


@query(f"""WITH {BARS_U} SELECT k, max(v) AS best, CAST(rank() OVER (ORDER BY max(v) DESC) AS INT) AS rank FROM bars_u GROUP BY k""", "best")
def wn30_best_rank(spark, d):
    from ..operators.topk import best_rank

    return best_rank(bars_u(spark, d), "k", "v", "ts").select("k", "best", "rank")


@query(f"""WITH {TICKS}, g AS (SELECT kind, avg(v) AS m, max(v) AS x FROM ticks GROUP BY kind), r AS (SELECT *, CAST(row_number() OVER (ORDER BY m DESC, kind) AS INT) AS rank, CAST(row_number() OVER (ORDER BY m, kind) AS INT) AS m_rank, CAST(row_number() OVER (ORDER BY x DESC, kind) AS INT) AS x_rank FROM g)
SELECT kind, m, x, rank, ['S', 'A', 'B', 'C', 'D'][rank] AS grade, m_rank, x_rank, CASE WHEN x_rank = 1 THEN 'peak' WHEN m_rank = 1 THEN 'weak' ELSE 'plain' END AS label FROM r""", "m x")
def wn22_wn23_rank_and_label_groups(spark, d):
    g = ticks(spark, d).groupBy("kind").agg(F.avg("v").alias("m"), F.max("v").alias("x"))
    return K.label_groups(K.rank_groups(g, "m", "kind"), "kind", {"m": True, "x": False}, [("peak", F.col("x_rank") == 1), ("weak", F.col("m_rank") == 1)], "plain")


@query(f"""WITH {BARS_U}, q AS (SELECT k, first(i ORDER BY v DESC, i) AS pi, max(v) AS pv FROM bars_u GROUP BY k) SELECT k, id, coalesce(i * 100.0 / nullif(pi, 0), 100) AS time_pct, v * 100 / pv AS value_pct FROM bars_u JOIN q USING (k)""", "time_pct value_pct")
def wn21_normalize_to_peak(spark, d):
    return K.normalize_to_peak(bars_u(spark, d), U, "v", "i").select("k", "id", "time_pct", "value_pct")

