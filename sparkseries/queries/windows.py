"""Window functions over keyed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch, ratio
from ..functions.windows import streak
from ..operators import features as X
from . import query
from .views import BARS_H, BARS_U, TRADES, H, U, bars_h, bars_u, secs, ticks, trades

W = "WINDOW w AS (PARTITION BY k ORDER BY ts, id)"
HW = "WINDOW w AS (PARTITION BY k ORDER BY ts)"


def fr(n: int, agg: str, extra: str = "ts, id") -> str:
    return f"{agg} OVER (PARTITION BY k ORDER BY {extra} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"WITH {BARS_U} SELECT k, id, (v / nullif(lag(v, 6) OVER w, 0) - 1) * 100 AS a, coalesce(v / nullif(lag(v, 3) OVER w, 0) - 1, 0) AS b FROM bars_u {W}", "a b")
def wn1_roc(spark, d):
    return bars_u(spark, d).select("k", "id", U.roc("v", 6, percent=True).alias("a"), U.roc("v", 3, head=0.0).alias("b"))


@query(f"WITH {BARS_U} SELECT k, id, v / nullif(lag(v, 4) OVER w, 0) - lag(v, 2) OVER w / nullif(lag(v, 6) OVER w, 0) AS a FROM bars_u {W}", "a")
def wn2_roc_accel(spark, d):
    return bars_u(spark, d).select("k", "id", U.roc_accel("v", 4, 2).alias("a"))


@query(f"WITH {BARS_U} SELECT k, id, ln(greatest(v, 1)) - ln(CASE WHEN lag(v) OVER w IS NULL THEN NULL ELSE greatest(lag(v) OVER w, 1) END) AS lr, v - lag(v) OVER w AS df FROM bars_u {W}", "lr df")
def wn3_stationary(spark, d):
    x = F.when(U.lag("v").isNotNull(), U.log_return("v"))
    return bars_u(spark, d).select("k", "id", x.alias("lr"), U.diff("v").alias("df"))


@query(f"""WITH {BARS_U} SELECT k, id, CASE WHEN {fr(6, 'count(v)')} >= 6 THEN {fr(6, 'avg(v)')} END AS ma, {fr(6, 'sum(v)')} AS sm, CASE WHEN {fr(12, 'count(v)')} >= 3 THEN {fr(12, 'stddev_samp(v)')} END AS sd, {fr(12, 'max(v)')} AS mx, {fr(12, 'min(v)')} AS mn FROM bars_u""", "ma sm sd mx mn")
def wn4_rolling(spark, d):
    return bars_u(spark, d).select("k", "id", U.rolling("v", 6).alias("ma"), U.rolling("v", 6, "sum", 1).alias("sm"), U.rolling("v", 12, "stddev_samp", 3).alias("sd"), U.rolling("v", 12, "max", 1).alias("mx"), U.rolling("v", 12, "min", 1).alias("mn"))


@query(f"""WITH {BARS_U}, x AS (SELECT *, coalesce({fr(12, 'sum(v * vol)')} / nullif({fr(12, 'sum(vol)')}, 0), v) AS vw FROM bars_u) SELECT k, id, vw, v / nullif(vw, 0) AS r, vw / nullif(lag(vw, 3) OVER w, 0) - 1 AS slope FROM x {W}""", "vw r slope", 9)
def wn5_vwap(spark, d):
    x = bars_u(spark, d).withColumn("vw", U.vwap("v", "vol", 12))
    return x.select("k", "id", "vw", ratio("v", "vw").alias("r"), U.roc("vw", 3).alias("slope"))


@query(f"""WITH {BARS_U} SELECT k, id, vol / nullif({fr(48, 'avg(vol)')}, 0) AS a, vol / nullif(avg(vol) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), 0) AS b FROM bars_u""", "a b")
def wn6_rvol(spark, d):
    return bars_u(spark, d).select("k", "id", U.rvol("vol").alias("a"), U.rvol("vol", include_current=False).alias("b"))


@query(f"""WITH {BARS_H} SELECT k, CAST(t AS BIGINT) AS ts, ({fr(6, 'sum(buy)', 'ts')} - {fr(6, 'sum(sell)', 'ts')}) / nullif({fr(6, 'sum(buy)', 'ts')} + {fr(6, 'sum(sell)', 'ts')}, 0) AS a, {fr(6, 'sum(buy)', 'ts')} / nullif({fr(6, 'sum(n)', 'ts')}, 0) AS b FROM bars_h""", "a b")
def wn7_order_flow(spark, d):
    return bars_h(spark, d).select("k", secs(), H.ofi("buy", "sell", 6).alias("a"), H.flow_ratio("buy", "n", 6).alias("b"))


@query(f"WITH {BARS_U} SELECT k, id, max(v) OVER w AS mx, min(v) OVER w AS mn, v / max(v) OVER w - 1 AS dd FROM bars_u {W}", "mx mn dd")
def wn8_drawdown(spark, d):
    return bars_u(spark, d).select("k", "id", U.running_max("v").alias("mx"), U.running_min("v").alias("mn"), U.drawdown("v").alias("dd"))


@query(f"""WITH {BARS_U}, d AS (SELECT *, coalesce(v < lag(v) OVER w, false) AS f FROM bars_u {W}), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER w AS isl FROM d {W}) SELECT k, id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY k, isl ORDER BY ts, id) AS BIGINT) AS streak FROM g""")
def wn9_streak(spark, d):
    b = bars_u(spark, d).withColumn("f", F.col("v") < U.lag("v"))
    return streak(b, U, F.col("f")).select("k", "id", "streak")


@query(f"""WITH {BARS_U} SELECT k, id, max(v) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS a, min(v) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS b, max(v) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM bars_u""", "a b c")
def wn10_future_extreme(spark, d):
    return bars_u(spark, d).select("k", "id", U.future_extreme("v", 6).alias("a"), U.future_extreme("v", 6, "min", True).alias("b"), U.future_extreme("v", None).alias("c"))


@query(f"WITH {BARS_U} SELECT k, id, coalesce(lead(v, 3) OVER w IS NOT NULL AND v >= greatest(lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w), false) AS p FROM bars_u {W}")
def wn11_local_peak(spark, d):
    return bars_u(spark, d).select("k", "id", F.coalesce(U.is_local_peak("v", 3), F.lit(False)).alias("p"))


@query(f"WITH {BARS_U} SELECT k, id, CASE WHEN lead(v, 4) OVER w IS NOT NULL THEN greatest(-1, least(10, lead(v, 4) OVER w / nullif(v, 0) - 1)) END AS f FROM bars_u {W}", "f")
def wn12_forward_return(spark, d):
    return bars_u(spark, d).select("k", "id", U.forward_return("v", 4, -1.0, 10.0).alias("f"))


@query(f"WITH {BARS_U} SELECT k, id, CASE WHEN {fr(8, 'count(v)')} >= 8 THEN {fr(8, 'regr_slope(v, i)')} END AS s FROM bars_u", "s")
def wn13_trend_slope(spark, d):
    return bars_u(spark, d).select("k", "id", U.trend_slope("v", "i", 8).alias("s"))


@query(f"""WITH {BARS_U} SELECT k, id, coalesce((v - {fr(12, 'min(v)')}) / nullif({fr(12, 'max(v)')} - {fr(12, 'min(v)')}, 0), 0.5) AS a, v / {fr(12, 'avg(v)')} - 1 AS b FROM bars_u""", "a b")
def wn14_range_position(spark, d):
    return bars_u(spark, d).select("k", "id", U.range_position("v", 12).alias("a"), U.ma_deviation("v", 12).alias("b"))


@query(f"""WITH {BARS_U} SELECT k, id, CASE WHEN {fr(12, 'count(*)')} >= 12 THEN {fr(6, 'avg(vol)')} / nullif(avg(vol) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING), 0) - 1 END AS a FROM bars_u""", "a")
def wn16_split_half_trend(spark, d):
    return bars_u(spark, d).select("k", "id", U.split_half_trend("vol", 12).alias("a"))


@query(f"""WITH {BARS_U} SELECT k, id, CAST({fr(5, 'sum(CASE WHEN v > 60 THEN 1 ELSE 0 END)')} AS BIGINT) AS c FROM bars_u""")
def wn17_confirm(spark, d):
    return bars_u(spark, d).select("k", "id", U.confirm(F.col("v") > 60, 5).alias("c"))


@query(f"""WITH {BARS_U}, x AS (SELECT *, {fr(6, 'avg(v)')} AS ma FROM bars_u) SELECT k, id, v > 100 AND NOT coalesce(lag(v > 100) OVER w, true) AS up, coalesce(v < ma AND lag(v) OVER w >= lag(ma) OVER w, false) AS down FROM x {W}""")
def wn18_edges(spark, d):
    x = bars_u(spark, d).withColumns({"ma": U.rolling("v", 6, min_periods=1), "hi": F.col("v") > 100})
    return x.select("k", "id", U.rising_edge(F.col("hi")).alias("up"), F.coalesce(U.cross_down("v", "ma"), F.lit(False)).alias("down"))


@query(f"""WITH {BARS_U}, x AS (SELECT *, CASE WHEN kind = 'click' THEN v END AS m FROM bars_u), y AS (SELECT *, last_value(m IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, first_value(m IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt FROM x
WINDOW p AS (PARTITION BY k ORDER BY ts, id), n AS (PARTITION BY k ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT k, id, pv AS f, nv AS b, coalesce(m, pv + (nv - pv) * (t - pt) / nullif(nt - pt, 0), pv) AS l FROM y""", "f b l")
def wn19_fill(spark, d):
    x = bars_u(spark, d).withColumns({"m": F.when(F.col("kind") == "click", F.col("v")), "t": epoch("ts")})
    return x.select("k", "id", U.ffill("m").alias("f"), U.bfill("m").alias("b"), U.interpolate("m", "t").alias("l"))


@query(f"WITH {TRADES} SELECT k, ord, line, sum(pnl) OVER (PARTITION BY k ORDER BY ts, ord, line ROWS UNBOUNDED PRECEDING) AS eq FROM trades", "eq", 4)
def wn20_cumulative_pnl(spark, d):
    from ..functions.windows import Series

    return trades(spark, d).select("k", "ord", "line", Series("k", ["ts", "ord", "line"]).cumulative("pnl").alias("eq"))


@query(f"""WITH {BARS_U}, x AS (SELECT *, CASE WHEN lag(h, 6) OVER w > 0 THEN h / lag(h, 6) OVER w - 1 ELSE 0 END AS ht, coalesce(vol / nullif({fr(12, 'avg(vol)')}, 0), 1) AS vs, v / max(v) OVER w - 1 AS dd, coalesce(coalesce(vol / nullif({fr(24, 'avg(vol)')}, 0), 0) < 0.5, false) AS dry FROM bars_u {W}),
g AS (SELECT *, sum(CASE WHEN dry THEN 0 ELSE 1 END) OVER w AS isl FROM x {W}) SELECT k, id, ht AS holder_trend, vs AS volume_surge, dd AS drawdown, CAST(least(sum(CASE WHEN dry THEN 1 ELSE 0 END) OVER (PARTITION BY k, isl ORDER BY ts, id), 24) AS BIGINT) AS dry_rows FROM g""", "holder_trend volume_surge drawdown")
def wn24_life_signals(spark, d):
    return X.life_signals(bars_u(spark, d), U, "v", "vol", "h").select("k", "id", "holder_trend", "volume_surge", "drawdown", "dry_rows")


@query(f"""WITH {BARS_U}, x AS (SELECT *, v / nullif(lag(v) OVER w, 0) - 1 AS r FROM bars_u {W}) SELECT k, id, coalesce(v / nullif(lag(v, 12) OVER w, 0) - 1, 0) AS roc_12, coalesce(CASE WHEN {fr(6, 'count(r)')} >= 2 THEN {fr(6, 'stddev_pop(r)')} END, 0) AS vol_6, coalesce(CASE WHEN {fr(6, 'count(v)')} >= 6 THEN {fr(6, 'regr_slope(v, i)')} END / nullif(v, 0), 0) AS slope_6, ln(1 + i) AS age FROM x {W}""", "roc_12 vol_6 slope_6 age", 7)
def wn25_momentum_features(spark, d):
    return X.momentum_features(bars_u(spark, d), U, "v", "vol", "i").select("k", "id", "roc_12", "vol_6", "slope_6", "age")


@query(f"""WITH {BARS_U}, x AS (SELECT *, coalesce(v / nullif(lag(v, 3) OVER w, 0) - 1, 0) AS roc_3, coalesce({fr(24, 'sum(v * vol)')} / nullif({fr(24, 'sum(vol)')}, 0), v) AS vw, v = max(v) OVER w AS pk FROM bars_u {W}) SELECT k, id, coalesce(roc_3 - lag(roc_3, 3) OVER w, 0) AS accel_3, coalesce(vw / nullif(lag(vw, 6) OVER w, 0) - 1, 0) AS vwap_slope, i - last_value(CASE WHEN pk THEN i END IGNORE NULLS) OVER w AS since_peak FROM x {W}""", "accel_3 vwap_slope")
def wn26_funnel_features(spark, d):
    return X.funnel_features(bars_u(spark, d), U, "v", "vol", "i").select("k", "id", "accel_3", "vwap_slope", "since_peak")


@query(f"""WITH {BARS_U}, x AS (SELECT *, coalesce(v / nullif(lag(v) OVER w, 0) - 1, 0) AS roc_1 FROM bars_u {W}) SELECT k, id, roc_1, coalesce(CASE WHEN {fr(12, 'count(roc_1)')} >= 2 THEN {fr(12, 'stddev_samp(roc_1)')} END, 0) AS std_12, coalesce(({fr(4, 'avg(vol)')} - {fr(12, 'avg(vol)')}) / nullif({fr(12, 'avg(vol)')}, 0), 0) AS volume_trend FROM x""", "roc_1 std_12 volume_trend")
def wn27_position_features(spark, d):
    return X.position_features(bars_u(spark, d), U, "v", "vol").select("k", "id", "roc_1", "std_12", "volume_trend")


@query(f"""WITH {BARS_U}, x AS (SELECT k, id, v / nullif(lag(v, 2) OVER w, 0) - 1 AS a, vol - lag(vol, 4) OVER w AS b FROM bars_u {W}), s AS (SELECT k, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM x GROUP BY k),
q AS (SELECT x.k, id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(greatest(-1, least(1, a / sa)) * CASE WHEN a IS NULL THEN 0 ELSE 1 END, 0) + coalesce(CASE WHEN b IS NULL THEN 0 ELSE greatest(-1, least(1, b / sb)) END, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END AS quality FROM x JOIN s USING (k))
SELECT k, id, quality, coalesce(quality < -0.5, false) AS tighten_stop, coalesce(quality > 0.5, false) AS extend_hold FROM q""", "quality")
def wn28_momentum_quality(spark, d):
    x = bars_u(spark, d).withColumns({"a": U.roc("v", 2), "b": F.col("vol") - U.lag("vol", 4)})
    return X.momentum_quality(x, "k", ["a", "b"]).select("k", "id", "quality", "tighten_stop", "extend_hold")


@query(f"WITH {BARS_U} SELECT k, id, (t - lag(t) OVER w) / 60 AS gap_min, coalesce(t - lag(t) OVER w > 86400, false) AS big FROM bars_u {W}", "gap_min")
def wn29_gaps(spark, d):
    g = epoch("ts") - epoch(U.lag("ts"))
    return ticks(spark, d).select("k", "id", (g / 60).alias("gap_min"), F.coalesce(g > 86400, F.lit(False)).alias("big"))


@query(f"WITH {BARS_U} SELECT k, id, last_value(CASE WHEN i % 12 = 0 THEN v END IGNORE NULLS) OVER w AS s FROM bars_u {W}", "s")
def wn32_sample_hold(spark, d):
    return bars_u(spark, d).select("k", "id", U.sample_hold("v", "i", 12).alias("s"))
