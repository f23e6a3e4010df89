"""Scaling, clustering and assignment to groups."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_reason, l2_distance
from ..functions.windows import Series


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column (1 where the deviation is 0)."""
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_scale"))])


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str], suffix: str = "_s") -> DataFrame:
    joined = df.crossJoin(F.broadcast(scaler))  # one row
    return joined.select(*df.columns, *[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")).alias(c + suffix) for c in cols])


def fit_kmeans(df: DataFrame, cols: list[str], k: int, seed: int, rank_by: str) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster, centroids): clusters are numbered by the median of ``rank_by``, smallest first.

    Centroids are (cluster, centroid array) rows, ready for ``assign_centroid``.
    """
    data = df.withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(data)
    found = model.transform(data)
    order = found.groupBy("_c").agg(F.expr(f"percentile({rank_by}, 0.5)").alias("_m")).withColumn("cluster", F.row_number().over(Window.orderBy("_m", "_c")) - 1)  # k rows
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_c int, centroid array<double>")
    return found.join(F.broadcast(order.select("_c", "cluster")), "_c").drop("_c", "_v"), centres.join(order, "_c").select("cluster", "centroid")


def assign_centroid(df: DataFrame, centroids: DataFrame, vector: str, label: str = "cluster") -> DataFrame:
    """Nearest centroid of each row with all distances (array in the order of labels); ties to the smaller label.

    Centroids (a few rows) are folded into one broadcast array, so rows are not multiplied.
    """
    table = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct(label, "centroid"))).alias("_t")))
    x = df.crossJoin(table).withColumn("distances", F.transform("_t", lambda c: l2_distance(F.col(vector), c["centroid"])))
    near = F.array_min(F.zip_with("distances", "_t", lambda d, c: F.struct(d.alias("d"), c[label].alias("c"))))
    return x.withColumn("_n", near).select(*df.columns, F.col("_n.c").alias(label), F.col("_n.d").alias("distance"), "distances")


def classify_state(df: DataFrame, centroids: DataFrame, vector: str, sigma: float = 2.0, label: str = "cluster") -> DataFrame:
    """Nearest centroid if it is within ``sigma`` times its radius (column ``radius``), else NULL; confidence falls from 1
    at the centre to 0 at the limit."""
    near = assign_centroid(df, centroids, vector, label)
    limit = F.col("radius") * sigma
    joined = near.join(F.broadcast(centroids.select(label, "radius")), label)
    inside = F.col("distance") <= limit
    return joined.select(*df.columns, F.when(inside, F.col(label)).alias(label), "distance", F.when(inside & (limit > 0), 1 - F.col("distance") / limit).when(inside, 1.0).otherwise(0.0).alias("confidence"))


def point_cloud(df: DataFrame, s: Series, v: str, holders: str, idx: str, step: int, horizon: int, min_value: float) -> DataFrame:
    """Every ``step``-th state of each series with its forward return: log value, age, log holders, holder growth, growth."""
    x = df.withColumns({"log_value": F.log10(F.greatest(F.col(v), F.lit(1.0))), "log_holders": F.log10(F.greatest(F.col(holders).cast("double"), F.lit(1.0))), "holder_growth": s.roc(holders, 1, head=0.0), "roc_6": s.roc(v, 6, head=0.0), "forward": s.forward_return(v, horizon, -1.0, 10.0)})
    return x.where((F.col(idx) % step == 0) & F.col("forward").isNotNull() & (F.col(v) >= min_value))


def fit_pca(df: DataFrame, cols: list[str], n: int):
    """(rows with an array column pc, model): principal components of the columns, explained variance in the model."""
    data = df.withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).withColumn("pc", vector_to_array("_p")).drop("_v", "_p"), model


def rank_groups(groups: DataFrame, score: str, key: str, grades: tuple[str, ...] = ("S", "A", "B", "C", "D")) -> DataFrame:
    """Groups ranked by score (best 1) with an ordinal grade; the last grade holds for all further ranks."""
    x = groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # one row for each group
    g = F.element_at(F.array(*[F.lit(v) for v in grades]), F.least(F.col("rank"), F.lit(len(grades))))
    return x.withColumn("grade", g)


def label_groups(profile: DataFrame, key: str, features: dict[str, bool], rules: list[tuple[str, Column]], rest: str) -> DataFrame:
    """Rank of each group by each feature (True: ascending) as ``<feature>_rank``, then the first rule that holds."""
    x = profile
    for c, up in features.items():  # one row for each group
        x = x.withColumn(f"{c}_rank", F.row_number().over(Window.orderBy(F.col(c) if up else F.desc(c), key)))
    return x.withColumn("label", first_reason(rules, rest))


def normalize_to_peak(df: DataFrame, s: Series, v: str, idx: str) -> DataFrame:
    """Time as percent of the peak's row number and value as percent of the peak."""
    peak = F.min(F.struct((-F.col(v)).alias("v"), F.col(idx).alias("i"))).over(s.all)
    return df.withColumns({"time_pct": F.coalesce(F.col(idx) * 100.0 / F.nullif(peak["i"], F.lit(0)), F.lit(100.0)), "value_pct": F.col(v) * 100.0 / F.nullif(-peak["v"], F.lit(0.0))})
