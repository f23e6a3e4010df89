"""Windowed aggregates, de-duplication and joins of streams. Windows are epoch-aligned and half-open, unlike the
per-key closed windows of ``operators.joins``; rows later than the watermark are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB: needed by keyed state, and keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write a stream to Parquet; without ``every`` all data that is there is processed and the query ends."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def for_each(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Call ``fn(batch, id)`` for each micro-batch; ``fn`` must give the same result when a batch is repeated."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_bars(ticks: DataFrame, by: str, ts: str, v: str, every: str = "5 minutes", delay: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """Tumbling open, high, low, close and count."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    g = ticks.withWatermark(ts, delay).groupBy(by, F.window(ts, every))
    return g.agg(F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def stream_sliding(bars: DataFrame, by: str, ts: str, aggs: list[Column], size: str = "24 hours", slide: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    g = bars.withWatermark(ts, delay).groupBy(by, F.window(ts, size, slide)).agg(*aggs)
    return g.withColumn("start", F.col("window.start")).drop("window")


def stream_sessions(ticks: DataFrame, by: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of activity without a gap: start, end (last row plus gap), rows."""
    g = ticks.withWatermark(ts, delay).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_dedup(bars: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """First arrival of each key within the watermark; what comes later belongs to the batch merge of snapshots."""
    return bars.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_score(bars: DataFrame, model: DataFrame, on: str, score: Column, name: str = "score") -> DataFrame:
    """Stream rows with a static model table (Spark broadcasts it if it is small)."""
    return bars.join(model, on).withColumn(name, score)


def stream_interval_join(a: DataFrame, b: DataFrame, by: str, a_ts: str, b_ts: str, before: str, after: str, delay: str = "1 hour") -> DataFrame:
    """Rows of both streams with equal key and b_ts in [a_ts - before, a_ts + after]; ``b``'s key is dropped."""
    left, right = a.withWatermark(a_ts, delay), b.withColumnRenamed(by, "_k").withWatermark(b_ts, delay)
    near = F.expr(f"{by} = _k AND {b_ts} >= {a_ts} - INTERVAL {before} AND {b_ts} <= {a_ts} + INTERVAL {after}")
    return left.join(right, near).drop("_k")


def stream_log(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only log: each micro-batch overwrites a folder of its own, so that a repeated batch leaves no doubles."""
    return for_each(df, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"), checkpoint)


def stream_upsert(df: DataFrame, path: str, checkpoint: str, keys: list[str], version: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keyed table of the latest row: each micro-batch (after ``prepare``) is merged with the last snapshot into a new
    one, ``snapshot=<batch>``; readers take the newest folder with ``latest``."""
    from ..sources.tables import upsert

    def merge(batch: DataFrame, i: int) -> None:
        rows = prepare(batch) if prepare else batch
        old = latest(batch.sparkSession, path, i)
        none = rows.limit(0) if old is None else old
        upsert(none, rows, keys, version).write.mode("overwrite").parquet(f"{path}/snapshot={i}")
        drop_before_last(batch.sparkSession, path, i)

    return for_each(df, merge, checkpoint)


def stream_keyed(df: DataFrame, table: KeyedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch (after ``prepare``) upserted into a keyed table: only the buckets of its keys are written, and a repeated batch changes nothing."""

    def merge(batch: DataFrame, i: int) -> None:
        rows = (prepare(batch) if prepare else batch).persist()  # a micro-batch, read for each step of the merge
        table.upsert(rows, i)
        table.vacuum()
        rows.unpersist()

    return for_each(df, merge, checkpoint)


def stream_watchlist(found: DataFrame, path: str, checkpoint: str, key: str, ts: str, ttl_hours: float, max_size: int) -> StreamingQuery:
    """Watch-list: new keys are inserted if absent, entries beyond the TTL or the size (oldest first) go."""
    from ..operators.topk import cap_watchlist
    from ..sources.tables import insert_if_absent

    def merge(batch: DataFrame, i: int) -> None:
        old = latest(batch.sparkSession, path, i)
        every = insert_if_absent(batch.limit(0) if old is None else old, batch, [key], [ts])
        now = every.agg(F.max(ts).alias("_now"))
        kept = cap_watchlist(every.crossJoin(F.broadcast(now)), ts, key, max_size, F.col("_now"), ttl_hours).drop("_now")  # one row
        kept.write.mode("overwrite").parquet(f"{path}/snapshot={i}")
        drop_before_last(batch.sparkSession, path, i)

    return for_each(found, merge, checkpoint)


def snapshots(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    """The file system of ``path`` and the batches that have a snapshot below it, in order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    return fs, sorted(int(n.split("=")[1]) for n in names if n.startswith("snapshot="))


def drop_before_last(spark: SparkSession, path: str, i: int) -> None:
    """Delete the snapshots that no reader needs once that of batch ``i`` is written: the one before it stays, since a repeated
    batch starts from it and readers may still hold it."""
    fs, found = snapshots(spark, path)
    for n in [n for n in found if n < i][:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot={n}"), True)


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest snapshot below ``path`` (of a batch below ``before``), None without one."""
    found = [n for n in snapshots(spark, path)[1] if before is None or n < before]
    return spark.read.parquet(f"{path}/snapshot={found[-1]}") if found else None
