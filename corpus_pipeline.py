"""The corpus pipeline: reject toxic documents, drop near-duplicates, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it again.

Rows with a null id or a null or empty text pass every stage like others (they have no shingles, passages or entries); repeated rows
with one id and text stay once; without labels or without evidence no text is toxic; an empty benchmark
contaminates nothing; empty documents give an empty result. Columns of documents beside the known ones are carried along, also under names
that stages use for their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseries.llm import decontaminate, minhash_dedup, mixing, sharding, toxicity
from sparkseries.llm._state import discard, written

SHARD_BYTES = 16 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("poisson_mixing", mix_sources),
    ("extendible_sharding", shard),
]

ORACLE_SQL = None  # the classifier of the first stage has no SQL form; tests hold the stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
