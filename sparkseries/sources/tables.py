"""Sinks, operational tables and keyed upserts over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES


def write_samples(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, times as ISO-8601 UTC."""
    df.write.mode("overwrite").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """An operational table under its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same table from a relational database."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Target with updates: for each key the row with the largest version, updates before target on ties."""
    both = target.withColumn("_p", F.lit(0)).unionByName(updates.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_p"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def insert_if_absent(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target with the updates whose key it does not have (the first of each new key in ``order``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = updates.join(target.select(*keys).distinct(), keys, "left_anti").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return target.unionByName(new, allowMissingColumns=True)


def save_model_table(df: DataFrame, path: str) -> None:
    """Model parameters (scalers, centroids, thresholds, coefficients) as one small Parquet file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_model_table(spark: SparkSession, path: str, max_rows: int = 100_000) -> DataFrame:
    """The table, marked for broadcast if it has at most ``max_rows`` rows."""
    df = spark.read.parquet(path)
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
