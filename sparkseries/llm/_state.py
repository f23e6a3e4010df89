"""Tables written between steps, and connected components over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (as in tests) a temporary folder is made and set once; on a cluster
    a missing setting is an error, because a driver's folder is not shared.
    """
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkseries-")
        spark.conf.set(_KEY, at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkseries/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def counted(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``written`` with aggregates of the rows that are observed while they are written, without a job of their own."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in sums.items()]), name)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node in ``edges(u bigint, v bigint)`` as (node, component = smallest node).

    Alternates large-star and small-star steps (joins and min aggregates only, so a node with very many
    edges is pre-aggregated and its join can be split) and writes the edges after each round. Stops
    when a round changes nothing. Empty edges give an empty result; loops and repeated edges are ignored.
    """
    pair = F.xxhash64("u", "v")
    state = {"mark": F.sum(pair.cast("decimal(20,0)")), "mask": F.bit_xor(pair)}
    now, mark = counted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **state)
    for _ in range(max_rounds):
        if not mark["rows"]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, found = counted(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", **state)
        discard(now)
        now, same, mark = new, found == mark, found
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
