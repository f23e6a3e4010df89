"""Readers and tables: events are laid out as payload rows by Spark, written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import landing as L
from ..sources.keyed import KeyedTable
from ..sources import readers as R
from ..sources import tables as T
from . import query
from .views import BARS_H, REGISTRY, TICKS, TRADES, bars_h, registry, ticks, trades


def landing(spark, name: str) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``; in local mode a temporary one if it is unset)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkseries-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/landing/{name}-{uuid.uuid4().hex}"


@query(f"WITH {REGISTRY} SELECT address, 'main' AS chain, CASE WHEN ck % 3 = 0 THEN symbol ELSE name END AS name, symbol FROM registry WHERE ck % 5 <> 0")
def src1_read_registry(spark, d):
    r = registry(spark, d).select("address", F.lit("main").alias("chain"), F.when(F.col("ck") % 3 != 0, F.col("name")).alias("name"), F.when(F.col("ck") % 5 != 0, F.col("symbol")).alias("symbol"))
    r.write.csv(path := landing(spark, "registry"))
    return R.read_registry(spark, path)


@query(f"WITH {BARS_H} SELECT k AS address, CAST(t AS BIGINT) AS ts, o AS open, c AS close, vol AS volume FROM bars_h WHERE n % 4 > 0", "open close volume")
def src2_read_candles(spark, d):
    """Milliseconds and seconds, numbers as text, and values that are none."""
    sec = F.unix_timestamp("ts")
    bar = F.struct(F.when(sec % 7200 == 0, sec * 1000).otherwise(sec).cast("string").alias("time"), *[F.col(a).cast("string").alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"))], F.when(F.col("n") % 4 > 0, F.col("c").cast("string")).otherwise("n/a").alias("close"), F.col("vol").cast("string").alias("volume"))
    docs = bars_h(spark, d).groupBy("k").agg(F.struct(F.collect_list(bar).alias("list")).alias("data"))  # a document is a key's snapshot file
    docs.write.partitionBy("k").json(path := landing(spark, "candles"))
    return R.read_candles(spark, path).select(F.regexp_replace("address", "^k=", "").alias("address"), F.unix_timestamp("ts").alias("ts"), "open", "close", "volume")


@query(f"WITH {TICKS} SELECT k, CASE WHEN kind = 'view' THEN 'holder_count' ELSE 'top10_holder_percent' END AS metric, count(*) AS n, sum(v) AS s FROM ticks WHERE kind IN ('view', 'click') GROUP BY ALL", "s", 3)
def src3_read_metrics(spark, d):
    p = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct(F.unix_timestamp("ts").alias("timestamp"), F.col("v").cast("string").alias("value"))))
    docs = ticks(spark, d).groupBy("k").agg(F.to_json(F.struct(F.struct(F.struct(p("view").alias("holder_count"), p("click").alias("top10_holder_percent")).alias("trends")).alias("data"))).alias("value"))  # a document is a key's snapshot file
    L.land(docs.select(F.col("k").cast("string").alias("address"), F.lit("trends").alias("dataset"), F.lit(1_700_000_000_000).alias("version"), "value"), path := landing(spark, "trends"))
    return R.read_landed_metrics(spark, path).groupBy(F.col("address").cast("bigint").alias("k"), "metric").agg(F.count("*").alias("n"), F.sum("value").alias("s"))


@query(f"WITH {TICKS} SELECT id, CAST(CASE WHEN kind = 'click' THEN vol ELSE 0 END AS BIGINT) AS swap, CAST(CASE WHEN kind = 'view' THEN vol ELSE 0 END - CASE WHEN kind = 'error' THEN vol ELSE 0 END AS BIGINT) AS big_flow FROM ticks")
def src4_read_holder_history(spark, d):
    m = lambda kind, key: F.when(F.col("kind") == kind, F.create_map(F.lit(key), F.col("vol").cast("bigint")))
    rows = ticks(spark, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("id").alias("totalHolders"), m("click", "swap").alias("newHoldersByAcquisition"), m("view", "whales").alias("holdersIn"), m("error", "sharks").alias("holdersOut"))
    rows.write.json(path := landing(spark, "holders"))
    from .. import schemas

    back = spark.read.schema(schemas.HOLDERS).json(path)
    back.coalesce(4).write.json(again := landing(spark, "holders"))
    return spark.read.schema(schemas.HOLDERS).json(again).select(F.col("totalHolders").alias("id"), R.map_sum("newHoldersByAcquisition", "swap").alias("swap"), (R.map_sum("holdersIn", "whales", "sharks") - R.map_sum("holdersOut", "whales", "sharks")).alias("big_flow"))


@query(f"WITH {BARS_H} SELECT k, CAST(t AS BIGINT) AS ts, c AS close, CASE WHEN n % 2 = 0 THEN vol END AS volume FROM bars_h", "close volume")
def src5_unpack_columnar_bars(spark, d):
    from .. import schemas

    day = F.to_date("ts")
    row = F.struct(F.unix_timestamp("ts").alias("t"), F.col("c"), F.when(F.col("n") % 2 == 0, F.col("vol").cast("string")).otherwise("none").alias("volume"))
    g = bars_h(spark, d).groupBy("k", day.alias("day")).agg(F.collect_list(row).alias("r"))  # a day of hourly bars
    arrays = {"t": F.col("r.t"), "c": F.col("r.c"), "volume": F.col("r.volume")}
    wide = g.select("k", *[(arrays[f.name] if f.name in arrays else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.COLUMNAR.fields])
    return R.unpack_columnar_bars(wide, "k").select("k", F.unix_timestamp("ts").alias("ts"), "close", "volume")


@query(f"WITH {BARS_H} SELECT CAST(t AS BIGINT) AS ts, sum(c) AS close, sum(buy - sell) AS net_volume, count(*) AS n FROM bars_h GROUP BY 1", "close net_volume")
def src6_read_enriched_bars(spark, d):
    b = bars_h(spark, d).select(F.unix_timestamp("ts").alias("timestamp"), F.col("c").cast("string").alias("close"), F.col("buy").cast("string").alias("buy_volume"), F.col("sell").cast("string").alias("sell_volume"))
    b.coalesce(8).select(F.struct("*").alias("x")).select("x.*").write.json(path := landing(spark, "bars"))
    from .. import schemas

    rows = spark.read.schema(schemas.FLAT_BAR).json(path)
    rows.write.option("ignoreNullFields", "false").json(again := landing(spark, "bars"))
    return spark.read.schema(schemas.FLAT_BAR).json(again).select(R.to_ts("timestamp").alias("ts"), *[R.safe_float(F.col(c), 0.0).alias(c) for c in ("close", "buy_volume", "sell_volume")]).groupBy(F.unix_timestamp("ts").alias("ts")).agg(F.sum("close").alias("close"), F.sum(F.col("buy_volume") - F.col("sell_volume")).alias("net_volume"), F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT k, id FROM ticks QUALIFY id % 4 = max(id % 4) OVER (PARTITION BY k, kind)")
def src7_latest_snapshot(spark, d):
    t = ticks(spark, d).withColumn("version", F.col("id") % 4)
    return R.latest_snapshot(t, ["k", "kind"]).select("k", "id")


@query(f"WITH {TICKS} SELECT k, id, v FROM ticks QUALIFY id % 3 = max(id % 3) OVER (PARTITION BY k)", "v")
def src7_landing_newest(spark, d):
    """A user's ticks in up to three snapshot documents, and the same again under a 5-minute name: only the newest of the asked dataset is opened."""
    row = F.struct("id", F.col("v").cast("string").alias("v"))
    docs = ticks(spark, d).groupBy(F.col("k").cast("string").alias("address"), (F.lit(1_700_000_000_000) + F.col("id") % 3).alias("version")).agg(F.to_json(F.struct(F.collect_list(row).alias("list"))).alias("value"))  # a document is a key's snapshot file
    names = docs.withColumn("dataset", F.explode(F.array(F.lit("candles"), F.lit("candles_5m"))))
    L.land(names.select("address", "dataset", "version", "value"), path := landing(spark, "newest"))
    rows = L.read_landing(spark, path, "candles", "list array<struct<id: bigint, v: string>>").select(F.col("address").cast("bigint").alias("k"), F.explode("doc.list").alias("x"))
    return rows.select("k", "x.id", R.safe_float(F.col("x.v")).alias("v"))


@query(f"""WITH {TICKS}, s AS (SELECT k, id, 0 AS source FROM ticks WHERE kind = 'click' UNION ALL SELECT k, id, 1 FROM ticks WHERE kind = 'view' UNION ALL SELECT k, id, 2 FROM ticks), n AS (SELECT *, count(*) OVER (PARTITION BY k, source) AS n FROM s)
SELECT k, id, source FROM n QUALIFY source = min(CASE WHEN n >= 14 THEN source END) OVER (PARTITION BY k)""")
def src8_prefer_source(spark, d):
    t = ticks(spark, d).select("k", "id", "kind")
    return R.prefer_source([t.where("kind = 'click'").drop("kind"), t.where("kind = 'view'").drop("kind"), t.drop("kind")], "k", 14)


@query(f"""WITH {TICKS}, b AS (SELECT k, CAST(floor(t / 43200) AS BIGINT) AS g, v, id, kind <> 'click' AS p FROM ticks WHERE kind IN ('click', 'view')) SELECT k, g, v, id FROM b QUALIFY row_number() OVER (PARTITION BY k, g ORDER BY p, id) = 1""", "v")
def src9_merge_snapshots(spark, d):
    t = ticks(spark, d).select("k", F.floor(F.unix_timestamp("ts") / 43200).alias("g"), "v", "id", "kind")
    return R.merge_snapshots(t.where("kind = 'click'").drop("kind"), t.where("kind = 'view'").drop("kind"), ["k", "g"], ["id"])


@query(f"WITH {TRADES} SELECT exit_reason, count(*) AS n, sum(pnl) AS pnl FROM trades WHERE exit_reason <> 'RF' GROUP BY 1", "pnl", 1)
def src10_samples_round_trip(spark, d):
    """Partitioned Parquet: the filter on the partition column prunes folders."""
    T.write_samples(trades(spark, d), path := landing(spark, "samples"), ["exit_reason"])
    return spark.read.parquet(path).where("exit_reason <> 'RF'").groupBy("exit_reason").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


@query(f"WITH {TICKS} SELECT id, v, CAST(floor(t) AS BIGINT) AS ts, kind FROM ticks", "v")
def src11_csv_json_round_trip(spark, d):
    t = ticks(spark, d).select("id", "v", "ts", "kind")
    T.write_csv(t.select("id", "v"), a := landing(spark, "csv"))
    T.write_json(t.select("id", "ts", "kind"), b := landing(spark, "json"))
    j = spark.read.schema("id bigint, ts string, kind string").json(b)
    return spark.read.schema("id bigint, v double").csv(a, header=True).join(j, "id").select("id", "v", F.unix_timestamp(R.parse_iso("ts")).alias("ts"), "kind")


@query(f"""WITH {TICKS} SELECT k, kind, id, v FROM ticks QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY id DESC) = 1""", "v")
def src13_upsert(spark, d):
    t = ticks(spark, d).select("k", "kind", "id", "v")
    target = T.upsert(t.where("id % 2 = 0").limit(0), t.where("id % 2 = 0"), ["k", "kind"], "id")
    return T.upsert(target, t.where("id % 2 = 1"), ["k", "kind"], "id")


@query(f"""WITH {TICKS} SELECT k, kind, id, v FROM ticks QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY id DESC) = 1""", "v")
def src13_bucketed_upsert(spark, d):
    """Four batches of changes into buckets, with compaction on the way."""
    t = ticks(spark, d).select("k", "kind", "id", "v")
    table = KeyedTable(spark, landing(spark, "keyed"), ["k", "kind"], "id", t.schema, buckets=16, max_deltas=2)
    for i in range(4):
        table.upsert(t.where(F.col("id") % 4 == i), i)
    return table.read()


@query(f"""WITH {TICKS} SELECT k, min(id) FILTER (kind = 'click') AS id FROM ticks GROUP BY k HAVING count(*) FILTER (kind = 'click') > 0 UNION ALL
SELECT k, min(id) FILTER (kind = 'view') FROM ticks GROUP BY k HAVING count(*) FILTER (kind = 'click') = 0 AND count(*) FILTER (kind = 'view') > 0""")
def src13_insert_if_absent(spark, d):
    t = ticks(spark, d).select("k", "id", "kind")
    first = T.insert_if_absent(t.drop("kind").limit(0), t.where("kind = 'click'").drop("kind"), ["k"], ["id"])
    return T.insert_if_absent(first, t.where("kind = 'view'").drop("kind"), ["k"], ["id"])


@query(f"WITH {TICKS} SELECT kind, 2 * count(*) AS n FROM ticks GROUP BY kind")
def src14_append_log(spark, d):
    t, path = ticks(spark, d), landing(spark, "log")
    T.append_log(t, path)
    T.append_log(t, path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT id, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS v_s FROM ticks", "v_s")
def src15_model_table(spark, d):
    from ..operators.cluster import apply_scaler, fit_scaler

    t = ticks(spark, d)
    T.save_model_table(fit_scaler(t, ["v"]), path := landing(spark, "model"))
    return apply_scaler(t, T.load_model_table(spark, path), ["v"]).select("id", "v_s")


@query("SELECT o_orderkey AS id, o_totalprice AS pnl FROM orders WHERE o_orderstatus = 'F'", "pnl")
def src12_operational_tables(spark, d):
    """Orders in the declared trades table, closed ones read back."""
    from ..schemas import TRADES as S

    o = spark.read.parquet(f"{d}/orders.parquet")
    have = {"id": F.col("o_orderkey"), "pnl": F.col("o_totalprice"), "exit_time": F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))}
    T.append_log(o.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.fields]), path := landing(spark, "trades"))
    return T.read_table(spark, "trades", path).where("exit_time is not null").select("id", "pnl")
