"""Top-k, neighbours, clustering and folds that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import ml as M
from ..operators import neighbours as N
from ..operators import scoring as G
from ..operators import stats as A
from ..operators import topk as T
from . import query
from .views import BARS_H, BARS_U, POINTS, REGISTRY, TICKS, U, bars_h, bars_u, points, registry, ticks

DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) ** 2)))"


@query(f"""WITH {POINTS}, p AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, c.label, {DIST.format(a='q.x', b='c.x')} AS distance FROM points q JOIN points c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0)
SELECT query, neighbour, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM p QUALIFY rank <= 5""", "distance")
def tk1_knn(spark, d):
    p = points(spark, d)
    return T.knn(p.where("vec_id % 25 = 0"), p, "vec_id", "x", 5).select("query", "neighbour", "distance", "rank")


@query(f"""WITH {POINTS}, p AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, c.label, {DIST.format(a='q.x', b='c.x')} AS distance FROM points q JOIN points c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY distance, neighbour) = 1)
SELECT query, neighbour, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM b QUALIFY rank <= 3""", "distance")
def jn15_knn_by_entity(spark, d):
    p = points(spark, d)
    return T.knn(p.where("vec_id % 25 = 0"), p, "vec_id", "x", 3, entity="label").select("query", "neighbour", "distance", "rank")


STATES = f"{BARS_U}, s AS (SELECT id, k, [ln(1 + v), coalesce(vol, 0) / 50, h::DOUBLE, i / 20] AS x FROM bars_u), p AS (SELECT q.id AS query, c.id AS neighbour, c.k, {DIST.format(a='q.x', b='c.x')} AS distance FROM s q JOIN s c ON q.id <> c.id WHERE q.id % 500 = 0)"


def states(spark, d):
    """The state of each user after each event, in four dimensions."""
    b = bars_u(spark, d)
    return b.select("id", "k", F.array(F.log1p("v"), F.coalesce("vol", F.lit(0.0)) / 50, F.col("h").cast("double"), F.col("i") / 20).alias("x"))


@query(f"WITH {STATES} SELECT query, neighbour, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM p QUALIFY rank <= 5", "distance")
def tk1_state_neighbours(spark, d):
    """Neighbours in a space of four dimensions through its cells."""
    s = states(spark, d)
    return N.knn(s.where("id % 500 = 0"), s, "id", "x", 5).select("query", "neighbour", "distance", "rank")


@query(f"WITH {STATES}, b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query, k ORDER BY distance, neighbour) = 1) SELECT query, neighbour, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM b QUALIFY rank <= 3", "distance")
def jn15_state_neighbours_by_user(spark, d):
    """The same, with the best row of each user."""
    s = states(spark, d)
    return N.knn(s.where("id % 500 = 0"), s, "id", "x", 3, entity="k").select("query", "neighbour", "distance", "rank")


@query(f"""WITH {POINTS}, i AS (SELECT vec_id, label AS n, list_slice(x, 1, 3 + label) AS x FROM points), p AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, {DIST.format(a='q.x', b='c.x')} AS distance FROM i q JOIN i c ON q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0)
SELECT query, neighbour, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM p QUALIFY rank <= 5""", "distance")
def tk2_prefix_knn(spark, d):
    i = points(spark, d).select("vec_id", F.col("label").alias("n"), F.slice("x", F.lit(1), F.col("label") + 3).alias("x"))
    return T.prefix_knn(i.where("vec_id % 25 = 0"), i, "vec_id", "n", "x", 5)


@query(f"WITH {BARS_U} SELECT k, id, v, CAST(row_number() OVER (PARTITION BY k ORDER BY v DESC, id) AS INT) AS rank FROM bars_u QUALIFY rank <= 3", "v")
def tk3_top_n_per_group(spark, d):
    return T.top_n_per_group(bars_u(spark, d), "k", [F.desc("v"), F.col("id")], 3).select("k", "id", "v", "rank")


@query(f"""WITH {REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bal, ck) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM registry), s AS (SELECT * FROM r WHERE i IN (SELECT CAST(floor(j * (c - 1) / 9.0) AS BIGINT) FROM range(0, 10) x(j))),
n AS (SELECT symbol, count(*) AS n FROM s GROUP BY 1), b AS (SELECT symbol, sum(n) OVER (ORDER BY symbol) - n AS b FROM n)
SELECT symbol, ck FROM (SELECT s.*, b, row_number() OVER (PARTITION BY s.symbol ORDER BY i) AS r FROM s JOIN b USING (symbol)) WHERE b + r <= 34""")
def tk4_even_sample(spark, d):
    return T.even_sample(registry(spark, d), "symbol", ["bal", "ck"], 10, 34).select("symbol", "ck")


@query(f"WITH {TICKS} SELECT id FROM ticks WHERE TIMESTAMP '2024-01-20 00:00:00' - ts <= INTERVAL 48 HOURS AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, id LIMIT 50")
def tk5_cap_watchlist(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return T.cap_watchlist(ticks(spark, d).where(F.col("ts") <= now), "ts", "id", 50, now, 48).select("id")


@query(f"WITH {TICKS} SELECT k, id FROM ticks QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, id DESC) <= 2")
def tk6_latest_per_key(spark, d):
    return T.latest_per_key(ticks(spark, d), "k", ["ts", "id"], 2).select("k", "id")


@query(f"WITH {TICKS} SELECT k, CAST(max(t) * 1000 AS BIGINT) AS last_ms FROM (SELECT k, floor(t * 1000) / 1000 AS t FROM ticks) GROUP BY k ORDER BY last_ms DESC, k LIMIT 20")
def tk8_scan_batch(spark, d):
    last = ticks(spark, d).groupBy("k").agg(F.max(F.unix_millis("ts")).alias("last_ms"))
    return T.scan_batch(last, "last_ms", "k", 20)


@query()
def tk9_approx_knn(spark, d):
    """Approximate: no SQL; tests measure its recall against tk1."""
    p = points(spark, d)
    return T.approx_knn(p.where("vec_id % 25 = 0"), p, "vec_id", "x", 1.3, 5, 0.5)


# --- clustering -------------------------------------------------------------------------------------


@query(f"WITH {BARS_U}, m AS (SELECT avg(v) AS a, stddev_pop(v) AS b, avg(vol) AS c, stddev_pop(vol) AS e FROM bars_u) SELECT id, (v - a) / b AS v_s, (vol - c) / e AS vol_s FROM bars_u, m", "v_s vol_s")
def ml1_scaler(spark, d):
    b = bars_u(spark, d)
    return K.apply_scaler(b, K.fit_scaler(b, ["v", "vol"]), ["v", "vol"]).select("id", "v_s", "vol_s")


CENTRES = f"""{POINTS}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x[i]) AS m FROM points, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
dd AS (SELECT vec_id, c.label AS cluster, {DIST.format(a='x', b='c')} AS distance FROM points, c)"""


def centres(spark, d):
    p = points(spark, d).withColumn("o", F.lit(0))
    return A.group_outcomes(p, "label", "x", "o").select(F.col("label").alias("cluster"), "centroid", F.col("radius_std").alias("radius"))


@query(f"WITH {CENTRES} SELECT vec_id, cluster, distance FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1", "distance")
def ml3_assign_centroid(spark, d):
    return K.assign_centroid(points(spark, d), centres(spark, d).select("cluster", "centroid"), "x").select("vec_id", "cluster", "distance")


@query(f"""WITH {CENTRES}, n AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1), r AS (SELECT p.label AS cluster, stddev_pop({DIST.format(a='x', b='c')}) AS radius FROM points p JOIN c ON p.label = c.label GROUP BY 1)
SELECT vec_id, CASE WHEN distance <= 8 * radius THEN cluster END AS cluster, distance, CASE WHEN distance <= 8 * radius THEN 1 - distance / (8 * radius) ELSE 0 END AS confidence FROM n JOIN r USING (cluster)""", "distance confidence")
def ml4_classify_state(spark, d):
    return K.classify_state(points(spark, d).drop("label"), centres(spark, d), "x", 8.0).select("vec_id", "cluster", "distance", "confidence")


@query(f"""WITH {BARS_U}, x AS (SELECT *, lead(v, 4) OVER (PARTITION BY k ORDER BY ts, id) / nullif(v, 0) - 1 AS f, h / nullif(lag(h) OVER (PARTITION BY k ORDER BY ts, id), 0) - 1 AS hg FROM bars_u)
SELECT k, id, log10(greatest(v, 1)) AS log_value, log10(greatest(h, 1)) AS log_holders, coalesce(hg, 0) AS holder_growth, greatest(-1, least(10, f)) AS forward FROM x WHERE i % 3 = 0 AND f IS NOT NULL AND v >= 5""", "log_value log_holders holder_growth forward")
def ml5_point_cloud(spark, d):
    return K.point_cloud(bars_u(spark, d), U, "v", "h", "i", 3, 4, 5.0).select("k", "id", "log_value", "log_holders", "holder_growth", "forward")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1) % 5 AS INT) AS fold, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1) % 5 AS INT) AS sfold FROM customer")
def ml7_folds(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    s = M.stratified_folds(c, "c_custkey", "c_mktsegment", 5).select("c_custkey", F.col("fold").alias("sfold"))
    return M.group_folds(c, "c_custkey", 5).select("c_custkey", "fold").join(s, "c_custkey")


@query(f"""WITH {BARS_H}, z AS (SELECT k, CAST(t AS BIGINT) AS ts, ln(1 + n) AS x, ln(1 + c) AS y FROM bars_h), m AS (SELECT avg(x) AS xm FROM z), s AS (SELECT count(*)::DOUBLE AS n, sum(x - xm) AS s1, sum((x - xm) ** 2) AS s2, sum((x - xm) ** 3) AS s3, sum((x - xm) ** 4) AS s4, sum(y) AS t0, sum((x - xm) * y) AS t1, sum((x - xm) ** 2 * y) AS t2, sum(y * y) AS yy FROM z, m),
q AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
f AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS c0, (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS c1, (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM q)
SELECT k, ts, 0.5 * greatest(-5, least(5, (y - (c0 + c1 * (x - xm) + c2 * (x - xm) ** 2)) / sqrt((yy - c0 * t0 - c1 * t1 - c2 * t2) / n))) AS composite FROM z, m, f""", "composite")
def ml14_residual_scores(spark, d):
    z = bars_h(spark, d).select("k", F.unix_timestamp("ts").alias("ts"), F.log1p("n").alias("x"), F.log1p("c").alias("y"))
    fits = A.poly2_fit(z.withColumn("pair", F.lit("x~y")), "x", "y", ["pair"])
    return G.residual_scores(z, fits, [("x", "y", 0.5)], "k").select("k", "ts", "composite")


@query(f"""WITH {TICKS}, s AS (SELECT v / 500 AS s, CASE WHEN vol > 40 AND v > 30 OR vol > 80 THEN 1 ELSE 0 END AS y FROM ticks), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s)
SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc, avg(CASE WHEN (s >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(y) AS base_rate FROM r""", "auc accuracy base_rate")
def ml15_auc(spark, d):
    t = ticks(spark, d).select((F.col("v") / 500).alias("s"), F.when(((F.col("vol") > 40) & (F.col("v") > 30)) | (F.col("vol") > 80), 1).otherwise(0).alias("y"))
    return A.auc(t, "s", "y")


