"""The views that queries start from, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: k (user), kind, id, ts, v, vol."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("k"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("vol"))


U = Series("k", ["ts", "id"])
H = Series("k", "ts")


def bars_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each event of a user, numbered from 0; h counts the user's signups so far (a holder-like series)."""
    t = ticks(spark, sf_dir)
    return t.withColumns({"i": U.idx().cast("bigint"), "h": U.cumulative((F.col("kind") == "signup").cast("bigint"))})


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type: k, ts, o, h, l, c, n, vol, buy, sell."""
    t = ticks(spark, sf_dir)
    at = F.struct("ts", "id")
    return t.groupBy(F.col("kind").alias("k"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("v", at).alias("o"), F.max("v").alias("h"), F.min("v").alias("l"), F.max_by("v", at).alias("c"), F.count("*").alias("n"), F.sum("vol").alias("vol"),
        F.sum(F.when(F.col("vol") >= 50, F.col("v")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("vol") < 50, F.col("v")).otherwise(0.0)).alias("sell"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades."""
    t = table(spark, sf_dir, "lineitem")
    gain = F.col("l_discount") - F.col("l_tax")
    return t.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), (gain * 100).alias("return_pct"), (F.col("l_extendedprice") * gain).alias("pnl"), F.col("l_quantity").alias("bars_held"), F.concat("l_returnflag", "l_linestatus").alias("exit_reason"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_extendedprice").alias("price"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("address"), F.col("c_mktsegment").alias("symbol"), F.col("n_name").alias("name"), F.col("c_custkey").alias("ck"), F.col("c_acctbal").alias("bal"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


TICKS = """ticks AS (SELECT user_id AS k, event_type AS kind, event_id AS id, ts, value AS v,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vol, epoch_us(ts) / 1e6 AS t FROM events)"""
BARS_U = TICKS + """, bars_u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, id) - 1 AS i,
  CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, id) AS BIGINT) AS h FROM ticks)"""
BARS_H = TICKS + """, bars_h AS (SELECT kind AS k, date_trunc('hour', ts) AS ts, epoch_us(date_trunc('hour', ts)) / 1e6 AS t,
  first(v ORDER BY ts, id) AS o, max(v) AS h, min(v) AS l, last(v ORDER BY ts, id) AS c, count(*) AS n, sum(vol) AS vol,
  sum(CASE WHEN vol >= 50 THEN v ELSE 0 END) AS buy, sum(CASE WHEN vol < 50 THEN v ELSE 0 END) AS sell
  FROM ticks GROUP BY 1, 2, 3)"""
TRADES = """trades AS (SELECT l_suppkey AS k, l_orderkey AS ord, l_linenumber AS line, (l_discount - l_tax) * 100 AS return_pct,
  l_extendedprice * (l_discount - l_tax) AS pnl, l_quantity AS bars_held, l_returnflag || l_linestatus AS exit_reason,
  l_shipdate AS ts, l_extendedprice AS price FROM lineitem)"""
REGISTRY = """registry AS (SELECT c_name AS address, c_mktsegment AS symbol, n_name AS name, c_custkey AS ck, c_acctbal AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
POINTS = """points AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, label FROM embeddings)"""


def secs(name: str = "ts") -> Column:
    """Whole seconds since 1970 of a time column, under the same name."""
    return F.unix_timestamp(name).alias(name)


def position_sql(views: str, rules: str, slippage: float = 0.0) -> str:
    """Recursive SQL for one position at a time over ``x(k, i, v, en, ...)`` of ``views``: ``s`` has for each row the position open
    after it (e, ev, pk) and, where ``rules`` closed one, its entry, price, peak, exit value and reason (oe, oev, opk, xv, why)."""
    return f"""WITH RECURSIVE {views}, s(k, i, e, ev, pk, oe, oev, opk, xv, why) AS (
SELECT k, i, CASE WHEN en THEN i END, CASE WHEN en THEN v * (1 + {slippage!r}) END, CASE WHEN en THEN v END, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM x WHERE i = 0 UNION ALL
SELECT k, i, CASE WHEN e IS NULL THEN CASE WHEN en THEN i END WHEN why IS NULL THEN e END, CASE WHEN e IS NULL THEN CASE WHEN en THEN v * (1 + {slippage!r}) END WHEN why IS NULL THEN ev END,
CASE WHEN e IS NULL THEN CASE WHEN en THEN v END WHEN why IS NULL THEN top END, e, ev, top, v * (1 - {slippage!r}), why FROM (SELECT *, CASE WHEN e IS NULL THEN NULL {rules} END AS why FROM
(SELECT x.*, s.e, s.ev, greatest(s.pk, x.v) AS top, x.i - s.e AS bars, CASE WHEN s.ev > 0 THEN (x.v / s.ev - 1) * 100 ELSE 0 END AS gain, CASE WHEN greatest(s.pk, x.v) > 0 THEN (1 - x.v / greatest(s.pk, x.v)) * 100 ELSE 0 END AS fall FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)))"""
