"""Filters, normalisation, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean as C
from . import query
from .views import BARS_H, BARS_U, REGISTRY, TICKS, TRADES, U, bars_h, bars_u, registry, secs, table, ticks, trades


@query(f"WITH {TICKS} SELECT id, CASE WHEN vol % 7 = 0 THEN -1.0 ELSE v END AS a, v + 1 AS b FROM ticks", "a b")
def flt1_safe_float(spark, d):
    t = ticks(spark, d).select("id", F.when(F.col("vol") % 7 == 0, F.lit("n/a")).otherwise(F.col("v").cast("string")).alias("x"), "v")
    return t.select("id", S.safe_float("x", -1.0).alias("a"), S.safe_float(F.col("v") + 1).alias("b"))


@query(f"WITH {TICKS} SELECT id, CAST(floor(t) AS BIGINT) AS a, CAST(floor(t) AS BIGINT) AS b FROM ticks")
def flt2_to_ts(spark, d):
    t = ticks(spark, d).select("id", F.floor(S.epoch("ts")).alias("s"))
    return t.select("id", F.unix_timestamp(S.to_ts(F.col("s").cast("string"))).alias("a"), F.unix_timestamp(S.to_ts(F.col("s") * 1000)).alias("b"))


@query(f"WITH {TICKS} SELECT id, CAST(floor(t) AS BIGINT) AS a FROM ticks")
def flt3_parse_iso(spark, d):
    t = ticks(spark, d).select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("x"))
    return t.select("id", F.unix_timestamp(S.parse_iso("x")).alias("a"))


@query(f"WITH {TICKS} SELECT id, CAST(floor(t / 300) * 300 AS BIGINT) AS a, CAST(floor(t / 3600) * 3600 AS BIGINT) AS b FROM ticks")
def flt4_floor_ts(spark, d):
    return ticks(spark, d).select("id", F.unix_timestamp(S.floor_ts("ts", 300)).alias("a"), F.unix_timestamp(S.floor_ts("ts", 3600)).alias("b"))


TRIM = "t0 AS (SELECT k, min(ts) AS t0 FROM bars_u WHERE v >= 30 GROUP BY k)"


@query(f"WITH {BARS_U}, {TRIM} SELECT k, id, v, (epoch_us(ts) - epoch_us(t0)) / 3.6e9 AS hours FROM bars_u JOIN t0 USING (k) WHERE ts >= t0", "v hours")
def flt5_trim_from_crossing(spark, d):
    x = C.trim_from_crossing(bars_u(spark, d), "k", "ts", "v", 30)
    return x.select("k", "id", "v", C.elapsed_hours("ts", "t0").alias("hours"))


@query(f"WITH {BARS_U}, {TRIM} SELECT k, id, (epoch_us(ts) - epoch_us(t0)) / 3.6e9 AS hours FROM bars_u JOIN t0 USING (k) WHERE ts >= t0 AND (epoch_us(ts) - epoch_us(t0)) / 3.6e9 <= 168", "hours")
def flt6_cap_horizon(spark, d):
    return C.cap_horizon(C.trim_from_crossing(bars_u(spark, d), "k", "ts", "v", 30), "ts", "t0", 168).select("k", "id", "hours")


PEAK = "pk AS (SELECT k, first(ts ORDER BY v DESC, ts) AS p FROM bars_u GROUP BY k)"


@query(f"WITH {BARS_U}, {PEAK} SELECT k, id, v FROM bars_u JOIN pk USING (k) WHERE ts <= p", "v")
def flt7_trim_to_peak(spark, d):
    return C.trim_to_peak(bars_u(spark, d), "k", "ts", "v").select("k", "id", "v")


LIFE = f"""{BARS_U}, {TRIM}, risen AS (SELECT b.*, t0 FROM bars_u b JOIN t0 USING (k) WHERE ts >= t0),
top AS (SELECT k, max(v) AS peak, first(ts ORDER BY v DESC, ts) AS p, max(ts) AS z FROM risen GROUP BY k),
fell AS (SELECT r.k, min(r.ts) AS f FROM risen r JOIN top USING (k) WHERE r.ts > p AND r.v <= 0.3 * peak GROUP BY r.k),
life AS (SELECT r.*, peak, p, coalesce(f, z) AS e FROM risen r JOIN top USING (k) LEFT JOIN fell USING (k) WHERE r.ts <= coalesce(f, z))"""


@query(f"WITH {LIFE} SELECT k, id, v, peak, CASE WHEN ts <= p THEN 'rise' ELSE 'decay' END AS phase FROM life", "v peak")
def flt8_lifecycle_window(spark, d):
    return C.lifecycle_window(bars_u(spark, d), "k", "ts", "v", 30, 0.3).select("k", "id", "v", "peak", "phase")


@query(f"WITH {BARS_U} SELECT k, id FROM bars_u WHERE k IN (SELECT k FROM bars_u GROUP BY k HAVING count(*) >= 70)")
def flt9_require_min_rows(spark, d):
    return C.require_min_rows(bars_u(spark, d), "k", 70).select("k", "id")


@query(f"WITH {BARS_U} SELECT k, id FROM bars_u WHERE k IN (SELECT k FROM bars_u GROUP BY k HAVING min(ts) >= TIMESTAMP '2024-01-01 12:00:00')")
def flt10_created_after(spark, d):
    t0 = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return C.created_after(bars_u(spark, d), "k", "ts", t0).select("k", "id")


@query(f"WITH {TRADES} SELECT ord, line, return_pct FROM trades WHERE return_pct > 0 AND pnl > 0", "return_pct")
def flt11_positive(spark, d):
    return C.positive(trades(spark, d), "return_pct", "pnl").select("ord", "line", "return_pct")


@query(f"""WITH {BARS_U}, m AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM bars_u GROUP BY k)
SELECT k, id, CASE WHEN s > 0 THEN greatest(m - 1.5 * s, least(m + 1.5 * s, v)) ELSE v END AS v FROM bars_u JOIN m USING (k)""", "v")
def flt12_clip_sigma(spark, d):
    return C.clip_sigma(bars_u(spark, d), "k", "v", 1.5).select("k", "id", "v")


@query(f"WITH {TICKS} SELECT id, greatest(2, least(20, v)) AS v FROM ticks", "v")
def flt13_clip(spark, d):
    return ticks(spark, d).select("id", S.clip("v", 2.0, 20.0).alias("v"))


@query(f"WITH {TICKS} SELECT id, CASE WHEN vol % 5 < 2 THEN 0.0 ELSE v END AS a FROM ticks", "a")
def flt14_sanitize(spark, d):
    x = F.when(F.col("vol") % 5 == 0, float("nan")).when(F.col("vol") % 5 == 1, float("inf")).otherwise(F.col("v"))
    return ticks(spark, d).select("id", S.sanitize(x).alias("a"))


@query(f"""WITH {BARS_U}, g AS (SELECT *, v / nullif(lag(v, 4) OVER (PARTITION BY k ORDER BY ts, id), 0) - 1 AS gain FROM bars_u)
SELECT k, id, gain FROM g WHERE v >= 10 AND h >= 2 AND gain >= 0.2""", "gain")
def flt15_scan_filter(spark, d):
    return C.scan_filter(bars_u(spark, d), U, "v", "h", 10, 2, 4, 0.2).select("k", "id", "gain")


@query(f"""WITH {BARS_U}, g AS (SELECT *, max(v) OVER w AS run_peak, arg_max(i, (v, -i)) OVER w AS peak_idx FROM bars_u
  WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT k, id, run_peak, peak_idx FROM g WHERE NOT (peak_idx < 5 AND i >= 20) AND NOT coalesce(v / nullif(h, 0) > 25, true)""", "run_peak")
def flt16_scam_filter(spark, d):
    return C.scam_filter(bars_u(spark, d), U, "v", "h", None, 1.0, 5, 25.0).select("k", "id", "run_peak", F.col("peak_idx").cast("bigint").alias("peak_idx"))


@query(f"""WITH {BARS_U} SELECT k, id, CASE WHEN h IS NULL THEN 'no_holders' WHEN h < 3 THEN 'few_holders' WHEN v / h > 8 THEN 'value_per_holder' END AS reason FROM bars_u""")
def flt17_snapshot_filter(spark, d):
    return C.snapshot_filter(bars_u(spark, d), "v", "h", 3, 8.0).select("k", "id", "reason")


@query(f"""WITH {BARS_U} SELECT k, id, CASE WHEN h < 4 THEN 'few_holders' WHEN vol > 80 THEN 'concentrated' END AS reason, h >= 4 AND vol <= 80 AS safe FROM bars_u""")
def flt18_safety_gate(spark, d):
    return C.safety_gate(bars_u(spark, d), "h", "vol", 4, 80.0).select("k", "id", "reason", "safe")


@query(f"""WITH {BARS_U}, g AS (SELECT *, v / nullif(lag(v, 3) OVER (PARTITION BY k ORDER BY ts, id), 0) - 1 AS r FROM bars_u)
SELECT k, id, CASE WHEN NOT coalesce(r > 0, false) THEN 'roc' WHEN NOT vol >= 20 THEN 'volume' WHEN NOT h >= 2 THEN 'holders' END AS reason,
  coalesce(r > 0, false) AND vol >= 20 AND h >= 2 AS enter FROM g""")
def flt19_entry_gate(spark, d):
    x = bars_u(spark, d).withColumn("r", U.roc("v", 3))
    return C.entry_gate(x, [("roc", F.col("r") > 0), ("volume", F.col("vol") >= 20), ("holders", F.col("h") >= 2)]).select("k", "id", "reason", "enter")


@query(f"""WITH {BARS_U}, g AS (SELECT *, (t - min(t) OVER (PARTITION BY k)) / 3600 AS age, v / max(v) OVER (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS of_high,
  v / nullif(lag(v, 3) OVER w, 0) - 1 AS roc, h / nullif(lag(h, 3) OVER w, 0) - 1 AS hg FROM bars_u WINDOW w AS (PARTITION BY k ORDER BY ts, id))
SELECT k, id, of_high, roc FROM g WHERE age < 400 AND of_high >= 0.5 AND roc >= 0.05 AND hg > 0 AND vol >= 1""", "of_high roc")
def flt20_breakout_gate(spark, d):
    return C.breakout_gate(bars_u(spark, d), U, "ts", "v", "h", "vol", 400, 0.5, 3).select("k", "id", "of_high", "roc")


@query(f"""WITH {REGISTRY} SELECT ck, CASE WHEN lower(address) LIKE '0x%' AND length(address) = 42 THEN 'evm' WHEN length(address) BETWEEN 32 AND 44 THEN 'base58' ELSE 'unknown' END AS a,
  CASE WHEN ck % 3 = 0 THEN 'evm' WHEN ck % 3 = 1 THEN 'base58' ELSE 'unknown' END AS b FROM registry""")
def flt21_detect_chain(spark, d):
    pad = F.when(F.col("ck") % 3 == 0, F.concat(F.lit("0X"), F.lpad(F.col("ck").cast("string"), 40, "0"))).when(F.col("ck") % 3 == 1, F.lpad(F.col("ck").cast("string"), 40, "z")).otherwise("x")
    return registry(spark, d).select("ck", S.detect_chain("address").alias("a"), S.detect_chain(pad).alias("b"))


@query(f"""WITH {REGISTRY}, m AS (SELECT *, CASE WHEN lower(symbol) = 'build' THEN 1 WHEN lower(address) = 'build' THEN 2 WHEN contains(lower(symbol), 'build') OR contains(lower(address), 'build') THEN 3 END AS tier FROM registry)
SELECT ck, symbol, tier FROM m WHERE tier = (SELECT min(tier) FROM m)""")
def flt22_search_registry(spark, d):
    return C.search_registry(registry(spark, d), "Build", "address", "symbol").select("ck", "symbol", "tier")


@query(f"""WITH {BARS_U}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, id) AS r FROM bars_u WHERE v >= 10) SELECT k, id FROM q WHERE (r - 1) % 12 = 0""")
def flt23_every_nth(spark, d):
    return C.every_nth(bars_u(spark, d).where("v >= 10"), "k", ["ts", "id"], 12).select("k", "id")


@query(f"WITH {TICKS} SELECT CASE WHEN v < 5 THEN 'low' WHEN v < 15 THEN 'mid' ELSE 'high' END AS tier, count(*) AS n FROM ticks GROUP BY 1")
def flt24_bucket(spark, d):
    return ticks(spark, d).groupBy(S.bucket("v", [5, 15], ["low", "mid", "high"]).alias("tier")).agg(F.count("*").alias("n"))


# --- set operations ---------------------------------------------------------------------------------


@query(f"WITH {TICKS} SELECT id, v, CASE WHEN kind = 'view' THEN NULL ELSE vol END AS vol FROM ticks", "v vol")
def st1_union_sources(spark, d):
    t = ticks(spark, d)
    return C.union_sources(t.where("kind = 'view'").select("id", "v"), t.where("kind <> 'view'").select("id", "v", "vol"))


@query(f"WITH {REGISTRY} SELECT ck, address FROM registry WHERE ck % 5 <> 0")
def st2_difference(spark, d):
    r = registry(spark, d).select("ck", "address")
    known = r.where("ck % 5 = 0").select(F.upper("address").alias("address"))
    return C.difference(r, known, on="address")


@query(f"WITH {TICKS} SELECT k, kind, first(id ORDER BY ts, id) AS id FROM ticks GROUP BY k, kind")
def st3_distinct_first(spark, d):
    return C.distinct_first(ticks(spark, d), ["k", "kind"], ["ts", "id"]).select("k", "kind", "id")


@query(f"""WITH {TICKS} SELECT k, count(*) AS n FROM (SELECT DISTINCT k, CAST(floor(t / 3600) AS BIGINT) AS b FROM ticks WHERE kind IN ('click', 'view')) GROUP BY k""")
def st4_union_timestamps(spark, d):
    t = ticks(spark, d).withColumn("ts", S.floor_ts("ts", 3600))
    return C.union_timestamps(t.where("kind = 'click'"), t.where("kind = 'view'"), "k", "ts").groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT k FROM ticks WHERE v > 60 INTERSECT SELECT k FROM ticks WHERE kind = 'error' AND vol > 90")
def st5_keys_in_all(spark, d):
    t = ticks(spark, d)
    return C.keys_in_all(t.where("v > 60"), t.where("kind = 'error' and vol > 90"), on="k")


@query(f"WITH {TICKS} SELECT 'train' AS part, count(*) AS n FROM ticks WHERE k % 5 <> 2 UNION ALL SELECT 'test', count(*) FROM ticks WHERE k % 5 = 2")
def st6_fold_split(spark, d):
    train, test = C.fold_split(ticks(spark, d).withColumn("fold", F.col("k") % 5), "fold", 2)
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n")).union(test.agg(F.lit("test").alias("part"), F.count("*").alias("n")))


# --- scalar functions -------------------------------------------------------------------------------


@query(f"WITH {TICKS}, x AS (SELECT id, v / 10 - 5 AS x FROM ticks) SELECT id, sign(x) * ln(1 + abs(x)) AS a, -ln(1 + greatest(-x, 0)) AS b, log10(greatest(x, 1)) AS c, exp(x / 10) - 1 AS e FROM x", "a b c e")
def sc1_signed_log(spark, d):
    x = F.col("v") / 10 - 5
    return ticks(spark, d).select("id", S.signed_log1p(x).alias("a"), S.neg_log1p(x).alias("b"), F.log10(F.greatest(x, F.lit(1.0))).alias("c"), F.expm1(x / 10).alias("e"))


@query(f"""WITH {BARS_U}, q AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM bars_u GROUP BY k)
SELECT k, id, (v - m) / CASE WHEN b - a > 0 THEN b - a ELSE 1 END AS v_rz FROM bars_u JOIN q USING (k)""", "v_rz")
def sc2_robust_z(spark, d):
    return C.robust_z(bars_u(spark, d), "k", ["v"]).select("k", "id", "v_rz")


@query(f"""WITH {BARS_U}, m AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s, min(v) AS a, max(v) AS b FROM bars_u GROUP BY k), g AS (SELECT avg(v) AS gm, stddev_pop(v) AS gs FROM bars_u)
SELECT k, id, (v - m) / greatest(s, 1e-8) AS v_z, coalesce((v - a) / nullif(b - a, 0), 0) AS v_mm, (v - gm) / gs AS v_g FROM bars_u JOIN m USING (k), g""", "v_z v_mm v_g")
def sc3_zscore(spark, d):
    x = C.minmax(C.zscore(bars_u(spark, d), "k", ["v"]), "k", ["v"])
    return C.zscore(x, None, ["v"], suffix="_g").select("k", "id", "v_z", "v_mm", "v_g")


@query(f"WITH {TICKS} SELECT id, greatest(0, least(1, (v - 2) / 18)) AS a FROM ticks", "a")
def sc4_ramp(spark, d):
    return ticks(spark, d).select("id", S.ramp("v", 2, 20).alias("a"))


@query(f"""WITH {TICKS} SELECT id, CASE WHEN v <= 2 THEN 1 WHEN v <= 12 THEN 1 - (v - 2) * 0.05 WHEN v <= 48 THEN 0.5 - (v - 12) * (0.5 / 36) ELSE 0 END AS f,
  CASE WHEN vol <> 0 THEN 1 END * greatest(0, least(1, (v * 0.3333771 / nullif(vol, 0) - 0.2) / 0.8)) * CASE WHEN v / 100 - 0.6 <= -0.5 THEN 0.5 ELSE 1 END AS h FROM ticks""", "f h")
def sc5_freshness_health(spark, d):
    h = S.health(F.col("v") * 0.3333771, "vol", F.col("v") / 100 - 0.6)
    return ticks(spark, d).select("id", S.freshness("v").alias("f"), h.alias("h"))


SPLIT = "(" + " + ".join(f"(('0x' || substr(md5(c_custkey::VARCHAR), {8 * i + 1}, 8))::BIGINT % 100) * {pow(16 ** 8, 3 - i, 100)}" for i in range(4)) + ") % 100"


@query(f"SELECT c_custkey, CAST({SPLIT} AS BIGINT) AS b, CASE WHEN {SPLIT} < 60 THEN 'train' ELSE 'test' END AS s FROM customer")
def sc9_hash_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.hash_bucket("c_custkey").alias("b"), S.hash_split("c_custkey").alias("s"))


@query(f"""WITH {TICKS} SELECT id, list_transform([2, 1, 0], lambda j: CAST(epoch(date_trunc('week', ts) - to_days(CAST(j * 7 AS INT))) AS BIGINT)) AS w FROM ticks""")
def sc10_week_windows(spark, d):
    return ticks(spark, d).select("id", F.transform(S.week_windows("ts", 3), lambda w: F.unix_timestamp(w["start"])).alias("w"))


@query("""SELECT event_id AS id, list_filter([CASE WHEN json_extract_string(props, '$.k')::INT > 90 THEN 'high' END, CASE WHEN value > 20 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL) AS flags FROM events""")
def sc11_trade_flags(spark, d):
    from ..operators.stats import trade_flags

    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return trade_flags(e, [("high", F.col("p.k") > 90), ("large", F.col("value") > 20), ("error", F.col("event_type") == "error")]).select(F.col("event_id").alias("id"), "flags")


@query("""WITH f AS (SELECT unnest(list_filter([CASE WHEN value > 20 THEN 'large' END, CASE WHEN value < 3 THEN 'small' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS flag FROM events)
SELECT flag, count(*) AS n FROM f GROUP BY flag ORDER BY n DESC, flag LIMIT 2""")
def sc12_flag_counts(spark, d):
    from ..operators.stats import flag_counts, trade_flags

    e = table(spark, d, "events")
    return flag_counts(trade_flags(e, [("large", F.col("value") > 20), ("small", F.col("value") < 3), ("error", F.col("event_type") == "error")]), 2)


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS a FROM events")
def sc13_map_sum(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), S.map_sum(m, "k", "missing").alias("a"))


@query("""SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS dist, sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE ** 2))) AS norm
FROM embeddings a, embeddings b WHERE b.vec_id = 0""", "dist norm")
def sc14_l2_distance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    zero = e.where("vec_id = 0").select(F.col("x").alias("y"))  # one row
    return e.crossJoin(F.broadcast(zero)).select("vec_id", S.l2_distance("x", "y").alias("dist"), S.norm("x").alias("norm"))


@query(f"""WITH {TICKS} SELECT id, substr(kind, 1, 3) AS a, concat_ws('; ', CASE WHEN v > 20 THEN 'large' END, CASE WHEN vol > 90 THEN 'busy' END) AS b, strftime(ts, '%Y-%m-%d') AS c FROM ticks""")
def sc15_text(spark, d):
    return ticks(spark, d).select("id", S.clip_text("kind", 3).alias("a"), S.join_reasons([("large", F.col("v") > 20), ("busy", F.col("vol") > 90)]).alias("b"), F.date_format("ts", "yyyy-MM-dd").alias("c"))


@query(f"WITH {BARS_H} SELECT k, CAST(t AS BIGINT) AS ts, o * 1.03 AS a, c * 0.97 AS b, (c / o - 1) * 100 AS p, (c / o - 1) * 50 AS m FROM bars_h", "a b p m")
def sc16_position_maths(spark, d):
    x = S.pnl("o", "c", F.lit(50.0))
    return bars_h(spark, d).select("k", secs(), S.slipped("o", 3, "buy").alias("a"), S.slipped("c", 3, "sell").alias("b"), x["percent"].alias("p"), x["amount"].alias("m"))


@query(f"WITH {TICKS} SELECT id, CASE kind WHEN 'error' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 ELSE 0.0 END AS f FROM ticks", "f")
def sc17_sell_fraction(spark, d):
    return ticks(spark, d).select("id", S.sell_fraction("kind", {"error": 1.0, "click": 0.5, "view": 0.25}).alias("f"))


@query(f"""WITH {BARS_U}, g AS (SELECT k, quantile_cont(v, 0.5) AS m, max(v) AS x, count(*) AS n FROM bars_u GROUP BY k)
SELECT k, list_filter([CASE WHEN m > 8 THEN 'steady' END, CASE WHEN x > 10 * m THEN 'spiky' END, CASE WHEN n > 70 THEN 'busy' END], lambda z: z IS NOT NULL) AS tags FROM g""")
def sc18_behaviour_tags(spark, d):
    g = bars_u(spark, d).groupBy("k").agg(F.expr("percentile(v, 0.5)").alias("m"), F.max("v").alias("x"), F.count("*").alias("n"))
    return g.select("k", S.tags([("steady", F.col("m") > 8), ("spiky", F.col("x") > 10 * F.col("m")), ("busy", F.col("n") > 70)]).alias("tags"))


@query(f"""WITH {BARS_U}, f AS (SELECT *, max(v) OVER w / nullif(v, 0) AS up, min(v) OVER w / nullif(v, 0) AS dn FROM bars_u WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT k, id, CASE WHEN up >= 2 THEN 'pump' WHEN dn <= 0.5 THEN 'dump' ELSE 'flat' END AS label FROM f""")
def sc19_forward_label(spark, d):
    x = bars_u(spark, d).withColumns({"up": S.ratio(U.future_extreme("v", 6, "max", True), "v"), "dn": S.ratio(U.future_extreme("v", 6, "min", True), "v")})
    return x.select("k", "id", S.forward_label("up", "dn", 2.0, 0.5).alias("label"))


@query(f"WITH {TICKS} SELECT id, exp(0.6 * ln(1 + v) + 0.4 * ln(1 + vol)) - 1 AS b FROM ticks", "b")
def sc20_blend(spark, d):
    return ticks(spark, d).select("id", S.blend("v", "vol", 0.6).alias("b"))


