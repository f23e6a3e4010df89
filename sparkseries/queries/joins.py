"""Joins and windows with a per-key origin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import floor_ts
from ..operators import features as X
from ..operators import joins as J
from . import query
from .views import BARS_H, BARS_U, REGISTRY, TICKS, TRADES, U, bars_h, bars_u, registry, table, ticks, trades

SIGNUPS = "su AS (SELECT k, ts, t, id, v AS m FROM ticks WHERE kind = 'signup')"


def signups(spark, d):
    """A sparse metric by user."""
    return ticks(spark, d).where("kind = 'signup'").select("k", "ts", F.col("v").alias("m"))


@query(f"""WITH {TICKS}, b AS (SELECT k, CAST(floor(t / 3600) * 3600 AS BIGINT) AS hour, sum(v) AS v FROM ticks WHERE kind <> 'signup' GROUP BY ALL),
m AS (SELECT k, CAST(floor(t / 3600) * 3600 AS BIGINT) AS hour, last(v ORDER BY ts) AS m FROM ticks WHERE kind = 'signup' GROUP BY ALL)
SELECT k, hour, v, m, coalesce(v / nullif(m, 0), 0) AS v_per_m FROM b JOIN m USING (k, hour)""", "v m v_per_m")
def jn1_hourly_join(spark, d):
    t = ticks(spark, d)
    b = t.where("kind <> 'signup'").groupBy("k", floor_ts("ts", 3600).alias("hour")).agg(F.sum("v").alias("v"))
    m = J.last_per_bucket(signups(spark, d), "k", "ts", floor_ts("ts", 3600), ["m"], "hour")
    return J.hourly_join(b, m, "k", "hour", "v", "m").withColumn("hour", F.unix_timestamp("hour"))


SIDES = """a AS (SELECT k, CAST(floor(t / 86400) AS BIGINT) AS ts, max(v) AS a FROM ticks WHERE kind = 'click' AND (k % 4 > 0 OR CAST(floor(t / 86400) AS BIGINT) % 2 = 0) GROUP BY ALL),
b AS (SELECT k, CAST(floor(t / 86400) AS BIGINT) AS ts, max(v) AS b FROM ticks WHERE kind = 'view' AND (k % 4 > 0 OR CAST(floor(t / 86400) AS BIGINT) % 2 = 1) GROUP BY ALL)"""


def sides(spark, d):
    t = ticks(spark, d).withColumn("day", F.floor(F.unix_timestamp("ts") / 86400))
    a = t.where("kind = 'click' and (k % 4 > 0 or day % 2 = 0)").groupBy("k", F.col("day").alias("ts")).agg(F.max("v").alias("a"))
    b = t.where("kind = 'view' and (k % 4 > 0 or day % 2 = 1)").groupBy("k", F.col("day").alias("ts")).agg(F.max("v").alias("b"))
    return a, b


@query(f"""WITH {TICKS}, {SIDES}, f AS (SELECT k, ts, a, b, max(a IS NOT NULL AND b IS NOT NULL) OVER (PARTITION BY k) AS matched,
  last_value(a IGNORE NULLS) OVER w AS fa, last_value(b IGNORE NULLS) OVER w AS fb FROM a FULL JOIN b USING (k, ts) WINDOW w AS (PARTITION BY k ORDER BY ts))
SELECT k, ts, fa AS a, fb AS b, matched FROM f WHERE (a IS NOT NULL AND b IS NOT NULL) OR (NOT matched AND fa IS NOT NULL AND fb IS NOT NULL)""", "a b")
def jn2_join_or_ffill(spark, d):
    return J.join_or_ffill(*sides(spark, d), "k", "ts", "a", "b")


def _lin(c: str) -> str:
    return f"""coalesce({c}, last_value({c} IGNORE NULLS) OVER p + (first_value({c} IGNORE NULLS) OVER n - last_value({c} IGNORE NULLS) OVER p) * (ts - last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER p)
  / nullif(first_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER n - last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER p, 0), last_value({c} IGNORE NULLS) OVER p)"""


@query(f"""WITH {TICKS}, {SIDES}, f AS (SELECT k, ts, {_lin('a')} AS a, {_lin('b')} AS b FROM a FULL JOIN b USING (k, ts)
WINDOW p AS (PARTITION BY k ORDER BY ts), n AS (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL""", "a b")
def jn3_align_metrics(spark, d):
    a, b = (x.withColumn("ts", F.timestamp_seconds(F.col("ts") * 86400)) for x in sides(spark, d))
    return J.align_metrics(a, b, "k", "ts", "a", "b").withColumn("ts", (F.unix_timestamp("ts") / 86400).cast("bigint"))


@query(f"""WITH {TICKS}, {SIDES} SELECT k, ts, a, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts), first_value(b IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS b
FROM a LEFT JOIN b USING (k, ts)""", "a b")
def jn4_left_fill(spark, d):
    a, b = sides(spark, d)
    return J.left_fill(a, b, "k", "ts", "b", -1.0)


@query(f"WITH {TICKS}, {SIGNUPS} SELECT x.k, x.id, m FROM (SELECT * FROM ticks WHERE kind <> 'signup') x ASOF LEFT JOIN su ON x.k = su.k AND x.ts >= su.ts", "m")
def jn5_asof_join(spark, d):
    return J.asof_join(ticks(spark, d).where("kind <> 'signup'").select("k", "ts", "id"), signups(spark, d), "k", "ts", ["m"]).select("k", "id", "m")


@query(f"""WITH {TICKS}, {SIGNUPS} SELECT x.k, x.id, CASE WHEN su.t - x.t <= 86400 THEN m END AS m FROM (SELECT * FROM ticks WHERE kind <> 'signup') x ASOF LEFT JOIN su ON x.k = su.k AND x.ts <= su.ts""", "m")
def jn5_asof_forward_tolerance(spark, d):
    return J.asof_join(ticks(spark, d).where("kind <> 'signup'").select("k", "ts", "id"), signups(spark, d), "k", "ts", ["m"], direction="forward", tolerance=86400).select("k", "id", "m")


@query(f"""WITH {TICKS}, {SIGNUPS}, e AS (SELECT k, first(ts ORDER BY v DESC, ts) AS p FROM ticks GROUP BY k)
SELECT k, coalesce(max_by(m, ts) FILTER (ts <= p), min_by(m, ts)) AS value_at, coalesce(min_by(m, ts) FILTER (ts > p), max_by(m, ts)) AS value_after, max_by(m, ts) AS value_last FROM e JOIN su USING (k) GROUP BY k""", "value_at value_after value_last")
def jn6_value_at(spark, d):
    e = ticks(spark, d).groupBy("k").agg(F.max_by("ts", F.struct("v", -F.unix_micros("ts"))).alias("p"))
    return J.value_at(signups(spark, d), e, "k", "ts", "m", "p").drop("p")


KEYS = """keys AS (SELECT k, min(ts) FILTER (c >= 30) AS origin, max(ts) AS last_ts FROM bars_h GROUP BY k HAVING min(ts) FILTER (c >= 30) IS NOT NULL),
wins AS (SELECT k, origin, w AS win, origin + to_hours(CAST(6 * w AS INT)) AS t_start FROM keys, range(0, 200) r(w) WHERE origin + to_hours(CAST(6 * w + 24 AS INT)) <= last_ts)"""


def _keys(bars):
    return J.origins(bars, "k", "ts", "c", 30)


@query(f"""WITH {BARS_H}, {KEYS} SELECT k, win, CAST(epoch(t_start) AS BIGINT) AS t0, count(*) AS n, sum(c) AS s FROM wins w JOIN bars_h b USING (k) WHERE b.ts BETWEEN t_start AND t_start + INTERVAL 24 HOURS GROUP BY ALL""", "s")
def jn7_sliding_windows(spark, d):
    b = bars_h(spark, d)
    return J.sliding_windows(b, _keys(b), "k", "ts").groupBy("k", "win", F.unix_timestamp("t_start").alias("t0")).agg(F.count("*").alias("n"), F.sum("c").alias("s"))


@query(f"""WITH {BARS_H}, {KEYS} SELECT k, win, count(*) AS n, min_by(n, ts) AS a, max_by(n, ts) AS z FROM wins w JOIN (SELECT k, ts, n FROM bars_h) b USING (k) WHERE b.ts BETWEEN t_start - INTERVAL 1 HOUR AND t_start + INTERVAL 25 HOURS GROUP BY ALL""")
def jn8_padded_windows(spark, d):
    b = bars_h(spark, d)
    return J.padded_windows(b.select("k", "ts", "n"), _keys(b), "k", "ts", 24, 6, 1).groupBy("k", "win").agg(F.min_by("n", "ts").alias("a"), F.max_by("n", "ts").alias("z"), F.count("*").alias("n"))


@query(f"""WITH {BARS_H}, {KEYS} SELECT k, win, max(c) AS mx, min(c) AS mn, count(*) AS n FROM wins w JOIN bars_h b USING (k) WHERE b.ts > t_start + INTERVAL 24 HOURS AND b.ts <= t_start + INTERVAL 72 HOURS GROUP BY ALL""", "mx mn")
def jn9_future_windows(spark, d):
    b = bars_h(spark, d)
    return J.future_windows(b, _keys(b), "k", "ts", 24, 6, 48).groupBy("k", "win").agg(F.max("c").alias("mx"), F.min("c").alias("mn"), F.count("*").alias("n"))


@query(f"""WITH {BARS_H}, {KEYS} SELECT k, win, max(b.c) AS h_peak, first(b.c ORDER BY b.ts) AS h_first, last(b.c ORDER BY b.ts) AS h_last, nullif(count(b.ts), 0) AS h_rows FROM wins w LEFT JOIN bars_h b USING (k) WHERE b.ts < t_start GROUP BY ALL""", "h_peak h_first h_last")
def jn10_history_at(spark, d):
    b = bars_h(spark, d)
    keys = _keys(b)
    w = J.sliding_windows(b.select("k", "ts"), keys, "k", "ts").select("k", "win", "t_start").distinct()
    return J.history_at(b, w, "k", "ts", "c").drop("t_start").where("h_rows is not null")


@query(f"""WITH {BARS_U}, e AS (SELECT k, i AS e FROM bars_u WHERE v >= 150) SELECT b.k, e.e AS entry_idx, b.i, b.v, b.i - e.e AS tick FROM e JOIN bars_u b ON b.k = e.k AND b.i BETWEEN e.e AND e.e + 11""", "v")
def jn11_entry_ticks(spark, d):
    b = bars_u(spark, d).select("k", "i", "v")
    return J.entry_ticks(b.where("v >= 150").select("k", F.col("i").alias("entry_idx")), b, "k", "entry_idx", "i", 12)


@query(f"""WITH {REGISTRY} SELECT ck, 'new' AS part FROM registry WHERE ck % 7 <> 0 UNION ALL SELECT ck, 'active' FROM registry WHERE ck % 4 = 0""")
def jn12_new_and_active(spark, d):
    r = registry(spark, d).select("ck", "address")
    upper = lambda c: r.where(c).select(F.upper("address").alias("address"))
    return J.new_keys(r, upper("ck % 7 = 0"), "address").select("ck", F.lit("new").alias("part")).union(J.active_only(r, upper("ck % 4 = 0"), "address").select("ck", F.lit("active")))


@query("""SELECT o_orderkey, l_linenumber, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_quantity > 30""", "o_totalprice")
def jn13_open_positions(spark, d):
    o = table(spark, d, "orders").withColumn("exit_time", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))).withColumnRenamed("o_orderkey", "ord")
    p = table(spark, d, "lineitem").where("l_quantity > 30").withColumnRenamed("l_orderkey", "ord")
    return J.open_positions(o, p, "ord").select(F.col("ord").alias("o_orderkey"), "l_linenumber", "o_totalprice")


@query(f"""WITH {BARS_U}, ind AS (SELECT k, i, v / nullif(lag(v, 2) OVER (PARTITION BY k ORDER BY ts, id), 0) - 1 AS roc FROM bars_u) SELECT b.k, b.i AS entry_idx, b.v, roc FROM bars_u b JOIN ind USING (k, i) WHERE b.vol > 95""", "v roc")
def jn14_features_at_entry(spark, d):
    b = bars_u(spark, d)
    return J.features_at_entry(b.where("vol > 95").select("k", F.col("i").alias("entry_idx"), "v"), b.select("k", "i", U.roc("v", 2).alias("roc")), "k", "entry_idx", "i")


@query(f"""WITH {BARS_U}, m AS (SELECT k, i AS mi FROM bars_u WHERE v >= 150) SELECT m.k, mi, max(v) / nullif(min_by(v, i), 0) AS best_multiple, max_by(v, i) / nullif(min_by(v, i), 0) AS last_multiple, count(*) - 1 AS rows_after
FROM m JOIN bars_u b ON b.k = m.k AND b.i >= mi GROUP BY ALL""", "best_multiple last_multiple")
def jn18_continuations(spark, d):
    b = bars_u(spark, d)
    return J.continuations(b.where("v >= 150").select("k", F.col("i").alias("mi")), b, "k", "mi", "i", "v")


@query(f"""WITH {TRADES} SELECT ord, line, r_name FROM trades t LEFT JOIN (SELECT r_regionkey, r_name FROM region) ON k % 7 = r_regionkey""")
def jn19_map_labels(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("b"), "r_name")
    return J.map_labels(trades(spark, d).withColumn("b", F.pmod(F.col("k").cast("bigint"), F.lit(7))), r, "b").select("ord", "line", "r_name")


@query(f"""WITH {TICKS}, a AS (SELECT k, min(t) AS a0, max(t) AS a1 FROM ticks GROUP BY k), b AS (SELECT k, min(t) AS b0, count(*) AS n FROM ticks WHERE kind = 'click' GROUP BY k)
SELECT k, (b0 - a0) / 3600 AS gap_hours, CAST(floor((a1 - a0) / 86400) + 1 AS BIGINT) AS expected, coalesce(n, 0) AS rows, coalesce(n, 0) < 0.4 * (floor((a1 - a0) / 86400) + 1) AS refresh FROM a LEFT JOIN b USING (k)""", "gap_hours")
def jn20_coverage_gap(spark, d):
    t = ticks(spark, d)
    return J.coverage_gap(t, t.where("kind = 'click'"), "k", "ts", 86400, 0.4).withColumn("expected", F.col("expected").cast("bigint"))


# --- features over windows --------------------------------------------------------------------------

WIN = f"""{BARS_H}, {KEYS}, x AS (SELECT w.k, w.win, b.ts, b.c, b.vol, (epoch(b.ts) - epoch(t_start)) / 3600 AS oh, row_number() OVER g AS i, count(*) OVER (PARTITION BY w.k, w.win) AS n,
  c / greatest(lag(c) OVER g, 1) - 1 AS r, c / greatest(max(c) OVER g, 1) - 1 AS dd FROM wins w JOIN bars_h b ON b.k = w.k AND b.ts BETWEEN t_start AND t_start + INTERVAL 24 HOURS WINDOW g AS (PARTITION BY w.k, w.win ORDER BY b.ts)),
feat AS (SELECT k, win, count(*) AS rows, min_by(c, ts) AS start, max_by(c, ts) AS "end", max(c) AS max, min(c) AS min, max_by(c, ts) / greatest(min_by(c, ts), 1) - 1 AS "return", (max(c) - min(c)) / greatest(min_by(c, ts), 1) AS range,
  max_by(c, ts) / greatest(min_by(c, ts) FILTER (oh >= 18), 1) - 1 AS return_6h, max_by(c, ts) / greatest(min_by(c, ts) FILTER (oh >= 12), 1) - 1 AS return_half, coalesce(stddev_pop(r), 0) AS volatility, coalesce(avg(r), 0) AS mean_return,
  min(dd) AS max_drawdown, coalesce(avg(r) FILTER (i * 2 > n) - avg(r) FILTER (i * 2 <= n), 0) AS momentum_shift, first(i ORDER BY c DESC, i) / count(*) AS peak_position, sum(vol) AS volume_total, avg(vol) AS volume_mean,
  coalesce(avg(vol) FILTER (i * 2 > n), 0) / greatest(coalesce(avg(vol) FILTER (i * 2 <= n), 0), 1) - 1 AS volume_trend, max(vol) / greatest(sum(vol), 1) AS volume_concentration FROM x GROUP BY ALL)"""


@query(f"WITH {WIN} SELECT * FROM feat", 'start "end" max min "return" range return_6h return_half volatility mean_return max_drawdown momentum_shift peak_position volume_total volume_mean volume_trend volume_concentration')
def ag7_window_features(spark, d):
    b = bars_h(spark, d)
    return X.window_features(b, _keys(b), "k", "ts", "c", "vol").drop("t_start")


@query(f"""WITH {BARS_H}, {KEYS} SELECT k, win, min_by(n, ts) AS m_start, max_by(n, ts) AS m_end, max_by(n, ts) / greatest(min_by(n, ts), 1) - 1 AS m_growth, count(*) AS m_rows FROM wins JOIN (SELECT k, ts, n FROM bars_h) b USING (k)
WHERE b.ts BETWEEN t_start - INTERVAL 1 HOUR AND t_start + INTERVAL 25 HOURS GROUP BY ALL""", "m_growth")
def ag7_holder_features(spark, d):
    b = bars_h(spark, d)
    return X.holder_features(b, _keys(b), "k", "ts", "n")


@query(f"""WITH {BARS_U}, r AS (SELECT b.*, (t - min(t) OVER (PARTITION BY k)) / 3600 AS hh FROM bars_u b), s AS (SELECT * FROM r WHERE hh <= 240),
g AS (SELECT k, min_by(v, ts) AS a, max_by(v, ts) FILTER (hh <= 40) AS p1, max_by(v, ts) FILTER (hh <= 80) AS p2, max_by(v, ts) FILTER (hh <= 120) AS p3, first(hh ORDER BY v DESC, hh) AS hp, coalesce(stddev_samp(vol), 0) AS vs, sum(vol) AS vt FROM s GROUP BY k),
b AS (SELECT k, max(x) AS busy FROM (SELECT k, floor(hh), sum(vol) AS x FROM s GROUP BY ALL) GROUP BY k)
SELECT k, p1 / greatest(a, 1) - 1 AS return_a, p2 / greatest(a, 1) - 1 AS return_b, p3 / greatest(a, 1) - 1 AS return_c, (p3 - p2 - (p2 - p1)) / greatest(a, 1) AS acceleration, hp AS hours_to_peak, vs AS volume_std, busy / greatest(vt, 1) AS hour_concentration
FROM g JOIN b USING (k)""", "return_a return_b return_c acceleration hours_to_peak volume_std hour_concentration")
def ag8_early_features(spark, d):
    return X.early_features(bars_u(spark, d), "k", "ts", "v", "vol", 240)


@query(f"""WITH {BARS_H}, x AS (SELECT *, buy - sell AS net, row_number() OVER (PARTITION BY k, CAST(ts AS DATE) ORDER BY ts) AS i, count(*) OVER (PARTITION BY k, CAST(ts AS DATE)) AS nn FROM bars_h)
SELECT k, CAST(floor(t / 86400) AS BIGINT) AS day, sum(net) AS net_sum, avg(net) AS net_mean, coalesce(avg(net) FILTER (i * 2 > nn), 0) - coalesce(avg(net) FILTER (i * 2 <= nn), 0) AS net_trend, sum(buy) / greatest(sum(sell), 1) AS buy_sell_ratio, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS positive_share
FROM x GROUP BY ALL""", "net_sum net_mean net_trend buy_sell_ratio positive_share")
def ag9_flow_features(spark, d):
    b = bars_h(spark, d).withColumn("day", F.floor(F.unix_timestamp("ts") / 86400))
    return X.flow_features(b, ["k", "day"], "ts", "buy", "sell")


@query(f"""WITH {BARS_H}, {KEYS}, w2 AS (SELECT DISTINCT w.k, win, t_start, origin FROM wins w JOIN bars_h b ON b.k = w.k AND b.ts BETWEEN t_start AND t_start + INTERVAL 24 HOURS)
SELECT w.k, win, max(b.c) AS h_peak, count(b.ts) AS h_rows, (epoch(t_start) - epoch(origin)) / 3600 AS h_age_hours, last(b.c ORDER BY b.ts) / greatest(first(b.c ORDER BY b.ts), 1) - 1 AS h_return, last(b.c ORDER BY b.ts) / greatest(max(b.c), 1) AS h_of_peak
FROM w2 w LEFT JOIN bars_h b ON b.k = w.k AND b.ts < t_start GROUP BY w.k, win, t_start, origin""", "h_peak h_age_hours h_return h_of_peak")
def ag10_history_features(spark, d):
    b = bars_h(spark, d)
    return X.history_features(b, _keys(b), "k", "ts", "c", 24, 6).select("k", "win", "h_peak", "h_rows", "h_age_hours", F.when(F.col("h_rows") > 0, F.col("h_return")).alias("h_return"), F.when(F.col("h_rows") > 0, F.col("h_of_peak")).alias("h_of_peak"))


@query(f"""WITH {BARS_H} SELECT k, CAST(floor(t / 86400) AS BIGINT) AS day, CASE WHEN stddev_pop(c) > 0 AND stddev_pop(vol) > 0 THEN corr(c, vol) ELSE 0 END AS corr FROM bars_h GROUP BY ALL""", "corr")
def ag28_window_corr(spark, d):
    return X.window_corr(bars_h(spark, d).withColumn("day", F.floor(F.unix_timestamp("ts") / 86400)), ["k", "day"], "c", "vol")


@query(f"""WITH {WIN}, fut AS (SELECT w.k, w.win, max(c) AS fx, min(c) AS fn, count(*) AS fr FROM wins w JOIN bars_h b ON b.k = w.k AND b.ts > t_start + INTERVAL 24 HOURS AND b.ts <= t_start + INTERVAL 72 HOURS GROUP BY ALL)
SELECT CASE WHEN fx / greatest("end", 1) >= 5 THEN 'pump' WHEN fn / greatest("end", 1) <= 0.2 THEN 'dump' ELSE 'flat' END AS label, count(*) AS n, avg(fx / greatest("end", 1)) AS mean_multiple FROM feat JOIN fut USING (k, win) WHERE fr >= 2 GROUP BY 1""", "mean_multiple")
def w1_window_samples(spark, d):
    """Workload W1: the sliding-window data set with features, history and labels, summed up by label."""
    s = X.window_samples(bars_h(spark, d), "k", "ts", "c", "vol", 30, up=5.0, down=0.2)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.avg("max_multiple").alias("mean_multiple"))
