"""Nested snapshot payloads to flat tables. Paths may be files, folders or globs of any store that Spark reads.

Files lie at ``.../{address}/{dataset}_{epoch_ms}.json``; address and snapshot version come from the path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import map_sum, parse_iso, safe_float, to_ts
from .landing import read_landing


def _with_path(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.withColumns({"address": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "version": F.regexp_extract(path, r"_(\d+)\.[^/]*$", 1).try_cast("bigint"), "dataset": F.regexp_extract(path, r"([^/]+?)(?:_\d+)?\.[^/.]*$", 1)})


def read_registry(spark: SparkSession, path: str, columns: int = 4) -> DataFrame:
    """(address, chain, name, symbol) of a header-less CSV with 4 or 3 columns; rows without a symbol drop out, a
    missing name is the symbol."""
    schema = schemas.REGISTRY_4 if columns == 4 else schemas.REGISTRY_3
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path, header=False)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = rows.withColumns({"symbol": blank("symbol"), "name": blank("name"), "chain": blank("chain") if columns == 4 else F.lit(None).cast("string")}).where("symbol is not null")
    return out.select("address", "chain", F.coalesce("name", "symbol").alias("name"), "symbol")


def _number(c: str) -> Column:
    return safe_float(F.col(c)).alias(c.split(".")[-1])


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Bars (address, dataset, version, ts, open, high, low, close, volume) of candle documents; rows without time or close drop out."""
    docs = _with_path(spark.read.schema(schemas.CANDLES).json(path, multiLine=True))
    rows = docs.select("address", "dataset", "version", F.explode("data.list").alias("b"))
    return rows.select("address", "dataset", "version", to_ts("b.time").alias("ts"), *[_number(f"b.{c}") for c in ("open", "high", "low", "close", "volume")]).where("ts is not null and close is not null")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Long metric series (address, version, metric, ts, value) of trend documents."""
    return metric_rows(_with_path(spark.read.schema(schemas.TRENDS).json(path, multiLine=True)))


def read_landed_metrics(spark: SparkSession, path: str, dataset: str = "trends") -> DataFrame:
    """The same from a landing folder (see ``landing``): the newest document of each address. A task opens many small files, and none is renamed to be written."""
    return metric_rows(read_landing(spark, path, dataset, schemas.TRENDS).select("address", "version", "doc.data"))


def metric_rows(docs: DataFrame) -> DataFrame:
    """Rows (address, version, metric, ts, value) of parsed trend documents; both metrics come from one reading."""
    series = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"data.trends.{m}").alias("points")) for m in ("holder_count", "top10_holder_percent")])
    points = docs.select("address", "version", F.explode(series).alias("s")).select("address", "version", "s.metric", F.explode("s.points").alias("p"))
    return points.select("address", "version", "metric", to_ts("p.timestamp").alias("ts"), _number("p.value")).where("ts is not null and value is not null")


def read_holder_history(spark: SparkSession, path: str) -> DataFrame:
    """Holder history with sums of its optional map entries: acquired by kind, and flow of large holders."""
    rows = _with_path(spark.read.schema(schemas.HOLDERS).json(path, multiLine=True))
    big_in, big_out = (map_sum(c, "whales", "sharks") for c in ("holdersIn", "holdersOut"))
    return rows.select("address", "version", parse_iso("timestamp").alias("ts"), F.col("totalHolders").alias("holders"), F.col("netHolderChange").alias("net_change"), F.col("holderPercentChange").alias("change_pct"),
                       *[map_sum("newHoldersByAcquisition", k).alias(k) for k in ("swap", "transfer", "airdrop")], big_in.alias("big_in"), (big_in - big_out).alias("big_flow")).where("ts is not null")


def unpack_columnar_bars(df: DataFrame, *keys: str) -> DataFrame:
    """Parallel arrays to rows: as many as there are times, NULL where another array is null or shorter."""
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "buyVolume": "buy_volume", "sellVolume": "sell_volume"}
    cols = [c for c in schemas.COLUMNAR.names if c != "t"]
    padded = F.arrays_zip(F.col("t").alias("t"), *[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c) for c in cols])
    rows = df.select(*keys, F.explode(F.slice(padded, 1, F.size("t"))).alias("b")).where("b.t is not null")
    counts = {"buyers", "sellers", "buys", "sells", "transactions"}
    return rows.select(*keys, to_ts("b.t").alias("ts"), *[(F.col(f"b.{c}") if c in counts else safe_float(F.col(f"b.{c}"))).alias(names.get(c, c)) for c in cols])


def read_columnar_bars(spark: SparkSession, path: str) -> DataFrame:
    return unpack_columnar_bars(_with_path(spark.read.schema(schemas.COLUMNAR).json(path, multiLine=True)), "address", "version")


def read_enriched_bars(spark: SparkSession, path: str) -> DataFrame:
    """Flat bar arrays with numbers (missing ones 0) and net volume."""
    rows = _with_path(spark.read.schema(schemas.FLAT_BAR).json(path, multiLine=True))
    numbers = ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "liquidity")
    counts = ("buyers", "sellers", "buys", "sells", "transactions")
    out = rows.select("address", "version", to_ts("timestamp").alias("ts"), *[safe_float(F.col(c), 0.0).alias(c) for c in numbers], *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.where("ts is not null").withColumn("net_volume", F.col("buy_volume") - F.col("sell_volume"))


# --- snapshots and sources --------------------------------------------------------------------------


def latest_snapshot(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """All rows of the newest version of each key (resolution or data set belongs to the keys)."""
    return df.withColumn("_v", F.max(version).over(Window.partitionBy(*keys))).where(F.col(version).eqNullSafe(F.col("_v"))).drop("_v")


def prefer_source(sources: list[DataFrame], key: str, min_rows: int = 1) -> DataFrame:
    """Rows of the first source (in list order) that has at least ``min_rows`` rows of a key, chosen by key; ``source`` is its number."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)))
    n = F.count("*").over(Window.partitionBy(key, "source"))
    best = F.min(F.when(F.col("_n") >= min_rows, F.col("source"))).over(Window.partitionBy(key))
    return both.withColumn("_n", n).withColumn("_best", best).where(F.col("source") == F.col("_best")).drop("_n", "_best")


def merge_snapshots(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Union with one row for each key: existing rows win, then the first in ``order``."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_p", *(order or []))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")
