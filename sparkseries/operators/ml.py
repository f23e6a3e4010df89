"""Folds, training and validation with MLlib trees.

Every fit and every level of a tree reads its rows again, so they are written once for all folds (where the session has a checkpoint folder).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blend, hash_bucket
from .stats import written_once


def _dealt(keys: DataFrame, key: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fold`` in the order of the key's md5 (within each group): numbered inside each of 4096 prefixes of the hash, from the number of
    rows with smaller prefixes on, so no task numbers all rows."""
    rows = keys.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_p", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p"))  # at most 4097 rows a group
    before = sizes.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_q_{c}") for c in by], (upto - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key)) - 1
    met = [F.col("_p").eqNullSafe(F.col("_q")), *[F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by]]
    placed = rows.withColumn("_i", place).join(before if by else F.broadcast(before), met)
    return placed.select(*keys.columns, ((F.col("_b") + F.col("_i")) % n).cast("int").alias("fold"))


def group_folds(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Adds ``fold``: whole keys, dealt in the order of their md5."""
    return df.join(_dealt(df.select(key).distinct(), key, n), key)


def hashed_folds(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Adds ``fold`` from the key's md5 alone: no shuffle, folds of about equal size."""
    return df.withColumn("fold", F.pmod(hash_bucket(key, 1000), F.lit(n)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, n: int = 5) -> DataFrame:
    """Adds ``fold``: dealt within each class, in the order of the key's md5."""
    return _dealt(df, key, n, (label,))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(counts.crossJoin(total).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))), label)  # one row for each class


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, cols))


def train_binary(df: DataFrame, cols: list[str], label: str, fold: str = "fold", folds: int = 5, trees: int = 20, depth: int = 4, seed: int = 1) -> DataFrame:
    """Out-of-fold P(label = 1) as ``p`` from class-balanced boosted trees."""
    df = written_once(df)
    data, out = assembled(balanced(df, label), cols), None
    for i in range(folds):
        model = GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed).fit(data.where(F.col(fold) != i))
        part = model.transform(data.where(F.col(fold) == i)).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")
        out = part if out is None else out.unionByName(part)
    return out


def train_multiclass(df: DataFrame, cols: list[str], label: str, fold: str = "fold", folds: int = 5, trees: int = 30, depth: int = 6, seed: int = 1) -> DataFrame:
    """Out-of-fold class (number) as ``pred`` from a class-balanced random forest."""
    df = written_once(df)
    data, out = assembled(balanced(df, label), cols), None
    for i in range(folds):
        model = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(data.where(F.col(fold) != i))
        part = model.transform(data.where(F.col(fold) == i)).select(*df.columns, F.col("prediction").cast("int").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def fit_multiple(df: DataFrame, cols: list[str], multiple: str, trees: int = 20, depth: int = 4, seed: int = 1):
    """Boosted regression of log1p(multiple)."""
    return GBTRegressor(labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed).fit(assembled(df, cols).withColumn("_y", F.log1p(multiple)))


def predict_multiple(df: DataFrame, model, cols: list[str], name: str) -> DataFrame:
    return model.transform(assembled(df, cols)).withColumn(name, F.expm1("prediction")).select(*df.columns, name)


def train_forward_multiple(df: DataFrame, base: list[str], history: list[str], multiple: str, fold: str = "fold", folds: int = 5, w: float = 0.5, **how) -> DataFrame:
    """Out-of-fold ``pred``: base and base + history regressions blended in log space."""
    df, out = written_once(df), None
    for i in range(folds):
        train, test = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        a, b = fit_multiple(train, base, multiple, **how), fit_multiple(train, base + history, multiple, **how)
        part = predict_multiple(predict_multiple(test, a, base, "_a"), b, base + history, "_b").withColumn("pred", blend("_a", "_b", w)).drop("_a", "_b")
        out = part if out is None else out.unionByName(part)
    return out


def importances(model, cols: list[str], spark) -> DataFrame:
    pairs = sorted(zip(cols, (float(x) for x in model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(c, x, i + 1) for i, (c, x) in enumerate(pairs)], "feature string, importance double, rank int")


def meta_filter(trades: DataFrame, model, cols: list[str], threshold: float) -> DataFrame:
    """Trades with P(good) of at least the threshold, as ``p``."""
    return model.transform(assembled(trades, cols)).withColumn("p", vector_to_array("probability")[1]).select(*trades.columns, "p").where(F.col("p") >= threshold)


def validate_oos(train: DataFrame, unseen: DataFrame, key: str, cols: list[str], multiple: str, **how) -> DataFrame:
    """Predictions for keys of ``unseen`` that the training data does not have."""
    fresh = unseen.join(train.select(key).distinct(), key, "left_anti")
    return predict_multiple(fresh, fit_multiple(train, cols, multiple, **how), cols, "pred")
