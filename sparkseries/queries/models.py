"""Models and workloads. Engine-specific fits have no SQL; tests check their invariants."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import cluster as K
from ..operators import features as X
from ..operators import ml as M
from ..operators import stats as A
from ..plans import workloads as P
from . import query
from .kernels import OPEN_AT_END, TRADE_SQL
from .stats import STAT_FLOATS, STATS
from .views import BARS_H, U, bars_h, bars_u, points, position_sql

COLS = ["roc_1", "std_12", "volume_trend", "vwap_ratio", "off_peak"]
HOW = {"trees": 5, "depth": 3}


def rows(spark, d):
    x = X.position_features(bars_u(spark, d), U, "v", "vol").withColumn("mult", ratio(U.future_extreme("v", 6, "max", True), "v")).where("mult is not null")
    return x.select("k", "id", *COLS, "mult", (F.col("mult") >= 2).cast("int").alias("y"), F.when(F.col("mult") >= 3, 2).when(F.col("mult") >= 1.2, 1).otherwise(0).alias("cls"))


def folded(spark, d):
    return M.hashed_folds(rows(spark, d), "k", 3)


def components(spark, d):
    """The embeddings with a column for each component, and the names of these columns."""
    p = points(spark, d)
    names = [f"x{i}" for i in range(p.agg(F.max(F.size("x"))).first()[0])]
    return p.select("vec_id", *[F.col("x")[i].alias(c) for i, c in enumerate(names)]), names


@query()
def ml2_kmeans(spark, d):
    p, names = components(spark, d)
    return K.fit_kmeans(p, names, 6, 7, "x0")[0].select("vec_id", "cluster")


@query()
def ml6_pca(spark, d):
    p, names = components(spark, d)
    return K.fit_pca(p, names, 3)[0].select("vec_id", "pc")


@query()
def ml8_train_binary(spark, d):
    return M.train_binary(folded(spark, d), COLS, "y", folds=3, **HOW).select("k", "id", "y", "fold", "p")


@query()
def ml9_train_multiclass(spark, d):
    return A.classification_report(M.train_multiclass(folded(spark, d), COLS, "cls", folds=3, **HOW), "cls", "pred")


@query()
def ml10_forward_multiple(spark, d):
    out = M.train_forward_multiple(folded(spark, d), COLS[:3], COLS[3:], "mult", folds=3, **HOW)
    return A.regression_report(out, "mult", "pred", 2.0)


def _model(spark, d):
    return GBTClassifier(labelCol="y", weightCol="weight", maxIter=5, maxDepth=3, seed=1).fit(M.assembled(M.balanced(rows(spark, d), "y"), COLS))


@query()
def ml11_importances(spark, d):
    return M.importances(_model(spark, d), COLS, spark)


@query()
def ml12_meta_filter(spark, d):
    return M.meta_filter(rows(spark, d), _model(spark, d), COLS, 0.55).select("k", "id", "p")


@query()
def ml13_validate_oos(spark, d):
    r = rows(spark, d)
    out = M.validate_oos(r.where("k % 4 <> 0"), r, "k", COLS, "mult", **HOW)
    return A.precision_at_k(out, "id", "pred", "y", "mult", [10, 50, 200])


SCAN = f"""WITH {BARS_H}, t0 AS (SELECT k, min(ts) AS t0 FROM bars_h WHERE c >= 30 GROUP BY k), x AS (SELECT b.* FROM bars_h b JOIN t0 USING (k) WHERE ts >= t0),
y AS (SELECT *, c / nullif(lag(c, 4) OVER w, 0) - 1 AS r, c / max(c) OVER w - 1 AS dd, max(c) OVER f / nullif(c, 0) AS up, min(c) OVER f / nullif(c, 0) AS dn FROM x WINDOW w AS (PARTITION BY k ORDER BY ts), f AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING))
SELECT k, CASE WHEN up >= 4 THEN 'pump' WHEN dn <= 0.05 THEN 'dump' ELSE 'flat' END AS label, count(*) AS n, avg(up) AS mean_multiple, avg(dd) AS mean_drawdown FROM y WHERE c >= 50 AND r >= 0.1 AND up IS NOT NULL GROUP BY ALL"""


@query(SCAN, "mean_multiple mean_drawdown")
def w0_scan_labels(spark, d):
    return P.scan_labels(bars_h(spark, d), "k", "ts", "c", 30, 50, 0.1, 4.0, 0.05)


@query()
def w1_early_warning(spark, d):
    return P.early_warning(bars_h(spark, d), "k", "ts", "c", "vol", 30, 5.0, 0.2, 3, **HOW).groupBy("grade").agg(F.count("*").alias("n"), F.avg("max_multiple").alias("mean_multiple"))


@query(f"""SELECT cfg, {STATS}, avg(peak_return_pct) AS mean_peak, avg(return_pct) / nullif(avg(peak_return_pct), 0) AS capture FROM (SELECT split_part(k, '|', 1) AS cfg, return_pct, bars_held, peak_return_pct FROM
({position_sql(BARS_H + """, b AS (SELECT k, c, ts, row_number() OVER w - 1 AS i, coalesce(c / nullif(lag(c, 2) OVER w, 0) - 1 > 0.5, false) AS en FROM bars_h WINDOW w AS (PARTITION BY k ORDER BY ts)),
x AS (SELECT g.stop || '_' || g.rows || '|' || k AS k, i, c AS v, en, g.stop, g.rows, max(i) OVER (PARTITION BY k, g.stop, g.rows) AS z FROM b, (SELECT * FROM (SELECT unnest([20, 40, 60]) AS stop), (SELECT unnest([6, 12]) AS rows)) AS g)""",
"WHEN fall > stop THEN 'trailing_stop' WHEN bars >= rows THEN 'time_stop' WHEN i = z THEN 'end_of_data'")} {TRADE_SQL} UNION ALL {OPEN_AT_END})) GROUP BY cfg""", STAT_FLOATS + " mean_peak capture")
def w2_backtest(spark, d):
    b = bars_h(spark, d)
    from .views import H

    return P.backtest(b, "k", "ts", "c", H.roc("c", 2) > 0.5, {f"{s}_{n}": (float(s), n) for s in (20, 40, 60) for n in (6, 12)})


@query()
def w3_lifecycle_candidates(spark, d):
    return P.lifecycle_candidates(bars_u(spark, d), "k", "ts", "v", "vol", "h", 30, 4, 2)


@query()
def w4_funnel(spark, d):
    return P.funnel(bars_u(spark, d), "k", ["ts", "id"], "v", "vol", "h", "i", 10, 0.2, 0.5, **HOW)
