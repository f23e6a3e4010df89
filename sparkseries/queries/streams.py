"""Streams over the events table: everything that is there is processed, then the sink is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state as S
from ..streaming import timed as M
from ..streaming import windows as W
from . import query
from .sources import landing
from .kernels import EPI
from .views import BARS_U, TICKS, position_sql, table

ORDER = ["ts", "id"]


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of ticks."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a glob may name a file as well as a folder
    return e.select(F.col("user_id").alias("k"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("vol"))


def drained(df: DataFrame, name: str) -> DataFrame:
    spark, at = df.sparkSession, landing(df.sparkSession, name)
    schema = df.schema
    W.start(df, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def stated(df: DataFrame, name: str) -> DataFrame:
    W.use_rocksdb(df.sparkSession)
    return drained(df, name)


@query(f"""WITH {TICKS} SELECT kind, CAST(floor(t / 3600) * 3600 AS BIGINT) AS start, first(v ORDER BY ts, id) AS open, max(v) AS high, min(v) AS low, last(v ORDER BY ts, id) AS close, count(*) AS n FROM ticks
WHERE floor(t / 3600) * 3600 + 3600 <= (SELECT max(t) - 600 FROM ticks) GROUP BY ALL""", "open high low close")
def ss1_stream_bars(spark, d):
    """Hours that the watermark has passed."""
    return drained(W.stream_bars(ticks(spark, d), "kind", "ts", "v", "1 hour", "10 minutes", "id"), "ss1").withColumn("start", F.unix_timestamp("start"))


@query(f"""WITH {TICKS}, x AS (SELECT kind, v, unnest(range(CAST(floor(t / 21600) AS BIGINT) - 3, CAST(floor(t / 21600) AS BIGINT) + 1)) * 21600 AS start FROM ticks)
SELECT kind, start, avg(v) AS mean, count(*) AS n FROM x WHERE start + 86400 <= (SELECT max(t) - 3600 FROM ticks) GROUP BY ALL""", "mean")
def ss2_stream_sliding(spark, d):
    return drained(W.stream_sliding(ticks(spark, d), "kind", "ts", [F.avg("v").alias("mean"), F.count("*").alias("n")]), "ss2").withColumn("start", F.unix_timestamp("start"))


@query(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY ts, id) < 14400 THEN 0 ELSE 1 END AS new FROM ticks), s AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY ts, id) AS s FROM g)
SELECT k, CAST(floor(min(t)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY k, s HAVING max(t) + 14400 <= (SELECT max(t) - 3600 FROM ticks)""")
def ss3_stream_sessions(spark, d):
    return drained(W.stream_sessions(ticks(spark, d), "k", "ts", "4 hours", "1 hour"), "ss3").select("k", F.unix_timestamp("start").alias("start"), "n")


@query(f"WITH {TICKS} SELECT k, CAST(floor(t / 3600) * 3600 AS BIGINT) AS hour FROM ticks GROUP BY ALL")
def ss4_stream_dedup(spark, d):
    t = ticks(spark, d).select("k", F.date_trunc("hour", "ts").alias("hour"))
    return drained(W.stream_dedup(t, ["k", "hour"], "hour", "1 day"), "ss4").withColumn("hour", F.unix_timestamp("hour"))


@query(f"WITH {TICKS}, m AS (SELECT kind, avg(v) AS m, stddev_pop(v) AS s FROM ticks GROUP BY kind) SELECT id, (v - m) / s AS score FROM ticks JOIN m USING (kind)", "score")
def ss5_stream_score(spark, d):
    from .views import ticks as batch

    model = batch(spark, d).groupBy("kind").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return drained(W.stream_score(ticks(spark, d).select("id", "kind", "v"), model, "kind", (F.col("v") - F.col("m")) / F.col("s")), "ss5").select("id", "score")


@query(f"WITH {TICKS} SELECT a.id AS a_id, b.id AS b_id FROM ticks a JOIN ticks b ON a.k = b.k AND a.kind = 'click' AND b.kind = 'view' AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 6 HOURS")
def ss6_stream_interval_join(spark, d):
    a = ticks(spark, d).where("kind = 'click'").select("k", F.col("id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = ticks(spark, d).where("kind = 'view'").select("k", F.col("id").alias("b_id"), F.col("ts").alias("b_ts"))
    return drained(W.stream_interval_join(a, b, "k", "a_ts", "b_ts", "1 HOUR", "6 HOURS"), "ss6").select("a_id", "b_id")


@query(f"""WITH {BARS_U}, l AS (SELECT k, list(v ORDER BY ts, id) AS vs, list(i ORDER BY ts, id) AS ids FROM bars_u GROUP BY k), e AS (SELECT k, unnest(ids) AS idx, unnest(list_transform(range(1, len(vs) + 1), lambda n: list_reduce(list_slice(vs, 1, n), lambda a, x: a + (x - a) * 2.0 / 14))) AS ema FROM l),
r AS (SELECT k, i AS idx, v / nullif(lag(v, 6) OVER (PARTITION BY k ORDER BY ts, id), 0) - 1 AS roc FROM bars_u) SELECT * FROM e JOIN r USING (k, idx)""", "ema roc")
def ss7_stream_indicators(spark, d):
    return stated(S.stream_state(ticks(spark, d).select("k", "ts", "id", "v"), "k", ORDER, S.Indicators, v="v", span=13, p=6), "ss7").select("k", "idx", "ema", "roc")


@query(f"""{position_sql(BARS_U + ", x AS (SELECT k, i, v, coalesce(vol > 70, false) AS en FROM bars_u)", "WHEN fall > 40 THEN 'trailing_stop' WHEN gain < -80 THEN 'hard_stop' WHEN bars >= 12 THEN 'time_stop'")}
SELECT k, oe AS entry_idx, i AS exit_idx, oev AS entry_value, xv AS exit_value, opk AS peak_value, (xv / oev - 1) * 100 AS return_pct, why AS exit_reason FROM s WHERE why IS NOT NULL""", "entry_value exit_value peak_value return_pct")
def ss8_stream_positions(spark, d):
    """Tests hold it to the batch simulator."""
    t = ticks(spark, d).select("k", "ts", "id", "v", (F.col("vol") > 70).alias("signal"))
    return stated(S.stream_state(t, "k", ORDER, S.Positions, v="v", signal="signal", stop=40.0, max_bars=12), "ss8")


@query(f"""WITH RECURSIVE {BARS_U}, x AS (SELECT k, i, v, coalesce(vol > 70, false) AS en, CASE kind WHEN 'error' THEN 'SL_50' WHEN 'purchase' THEN 'TP_25' ELSE 'HOLD' END AS act FROM bars_u),
s(k, i, e, ev, rest, made, oe, action, sold, remaining) AS (SELECT k, i, CASE WHEN en THEN i END, v, 1::DOUBLE, 0::DOUBLE, NULL::BIGINT, NULL::VARCHAR, 0::DOUBLE, 0::DOUBLE FROM x WHERE i = 0 UNION ALL
SELECT k, i, CASE WHEN e IS NULL THEN CASE WHEN en THEN i END WHEN rest - cut > 0.001 THEN e END, CASE WHEN e IS NULL THEN v ELSE ev END, CASE WHEN e IS NULL THEN 1 ELSE rest - cut END, CASE WHEN e IS NULL THEN 0 ELSE made + cut * (v - ev) / greatest(ev, 1) END, e, act, cut, rest - cut FROM
(SELECT *, CASE WHEN e IS NULL THEN 0 ELSE least(rest, CASE act WHEN 'EXIT' THEN 1 WHEN 'SL_50' THEN 0.5 WHEN 'TP_25' THEN 0.25 ELSE 0 END) END AS cut FROM
(SELECT x.k, x.i, x.v, x.en, CASE WHEN x.i - s.e >= 12 THEN 'EXIT' ELSE x.act END AS act, s.e, s.ev, s.rest, s.made FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)))
SELECT k, oe AS entry_idx, i AS idx, action, sold, remaining, made AS realized FROM s WHERE sold > 0""", "sold remaining realized")
def ss9_stream_partial_positions(spark, d):
    act = F.when(F.col("kind") == "error", "SL_50").when(F.col("kind") == "purchase", "TP_25").otherwise("HOLD")
    t = ticks(spark, d).select("k", "ts", "id", "v", (F.col("vol") > 70).alias("signal"), act.alias("action"))
    return stated(S.stream_state(t, "k", ORDER, S.PartialPositions, v="v", signal="signal", action="action", max_bars=12, fractions={"SL_50": 0.5, "TP_25": 0.25, "EXIT": 1.0}), "ss9")


@query(f"""WITH RECURSIVE {TICKS}, x AS (SELECT k % 32 AS p, k AS token, kind = 'click' AS op, vol - 50 AS pnl, t, CAST(floor(t / 86400) AS BIGINT) AS day, row_number() OVER (PARTITION BY k % 32 ORDER BY ts, id) AS i FROM ticks WHERE kind IN ('click', 'purchase')),
s(p, i, token, ok, reason, held, capital, day, n, loss, results, closed) AS (SELECT DISTINCT p, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR, []::BIGINT[], 1000::DOUBLE, NULL::BIGINT, 0::BIGINT, 0::DOUBLE, []::BOOLEAN[], []::STRUCT(token BIGINT, t DOUBLE)[] FROM x UNION ALL
SELECT p, i, token, CASE WHEN op THEN reason IS NULL END, reason, CASE WHEN hit THEN list_filter(held, lambda o: o <> token) WHEN op AND reason IS NULL THEN list_append(held, token) ELSE held END, capital + CASE WHEN hit THEN 100 + pnl WHEN op AND reason IS NULL THEN -100 ELSE 0 END, day,
n + CASE WHEN op AND reason IS NULL THEN 1 ELSE 0 END, loss + CASE WHEN hit THEN least(pnl, 0) ELSE 0 END, CASE WHEN hit THEN list_slice(list_append(results, pnl > 0), greatest(1, len(results) - 3), len(results) + 1) ELSE results END, CASE WHEN hit THEN list_filter(list_append(closed, {{'token': token, 't': t}}), lambda c: t - c.t < 86400) ELSE closed END
FROM (SELECT *, NOT op AND list_contains(held, token) AS hit, CASE WHEN NOT op THEN NULL WHEN list_contains(held, token) THEN 'already_open' WHEN len(held) >= 4 THEN 'max_open' WHEN capital < 100 THEN 'capital' WHEN -loss >= 80 THEN 'daily_loss' WHEN n >= 6 THEN 'trades_per_day'
WHEN len(results) = 5 AND NOT list_contains(results, true) THEN 'win_rate' WHEN len(list_filter(closed, lambda c: c.token = token AND t - c.t < 86400)) > 0 THEN 'cooldown' END AS reason FROM
(SELECT x.*, s.held, s.capital, CASE WHEN s.day = x.day THEN s.n ELSE 0 END AS n, CASE WHEN s.day = x.day THEN s.loss ELSE 0 END AS loss, s.results, s.closed FROM s JOIN x ON x.p = s.p AND x.i = s.i + 1))) SELECT p, token::VARCHAR AS token, ok, reason FROM s WHERE ok IS NOT NULL""")
def ss10_stream_risk_gate(spark, d):
    """Users dealt to 32 portfolios; clicks ask to open, purchases close with a profit."""
    t = ticks(spark, d).where("kind in ('click', 'purchase')").select((F.col("k") % 32).alias("p"), "ts", "id", F.col("k").alias("token"), F.when(F.col("kind") == "click", "open").otherwise("close").alias("kind"), (F.col("vol") - 50).alias("pnl"))
    return stated(S.stream_state(t, "p", ORDER, S.RiskGate, token="token", capital=1000.0, size=100.0, max_open=4, max_loss=80.0, max_trades=6, window=5, min_win_rate=0.2, cooldown=86400.0), "ss10")


@query(f"WITH {TICKS}, f AS (SELECT k, min(ts) AS ts FROM ticks GROUP BY k), n AS (SELECT max(ts) AS now FROM f) SELECT k FROM f, n WHERE now - ts <= INTERVAL 48 HOURS ORDER BY ts DESC, k LIMIT 40")
def ss11_stream_watchlist(spark, d):
    at = landing(spark, "ss11")
    W.stream_watchlist(ticks(spark, d).select("k", "ts"), f"{at}/list", f"{at}/checkpoint", "k", "ts", 48, 40).awaitTermination()
    return W.latest(spark, f"{at}/list").select("k")


def growth_stream(spark, d):
    """Ticks with the growth over two rows of their user, from a first stateful operator that hands the watermark on."""
    t = ticks(spark, d).select("k", "ts", "id", "v").withWatermark("ts", "10 minutes")
    return M.stream_timed(t, "k", ORDER, M.Growth, ["ts", "id", "v"], "ts", v="v", p=2)


EPISODE = {"v": "v", "roc": "roc", "min_roc": 50.0, "max_fall": 60.0, "min_bars": 2}


@query(f"""{EPI} SELECT k, de AS entry_idx, i AS exit_idx, i - de AS duration, dv AS entry_value, dp AS peak_value, dx AS exit_value FROM s WHERE done AND i - de >= 2""", "entry_value peak_value exit_value")
def ss12_stream_episodes(spark, d):
    """One streaming query of two chained stateful operators; a year of silence ends no episode here."""
    e = M.stream_timed(growth_stream(spark, d), "k", ORDER, M.Episodes, idle_ms=365 * 86_400_000, **EPISODE)
    return stated(e, "ss12").where("observed").drop("observed")


IDLE, HOLD, TTL, DELAY = 8 * 3_600_000, 12 * 3_600_000, 12 * 3_600_000, 600_000


@query(f"""WITH RECURSIVE {BARS_U}, m AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM bars_u),
x AS (SELECT k, i, v, ms, lag(v) OVER w AS pv, ms - lag(ms) OVER w > {IDLE} AS gap, (v / nullif(lag(v, 2) OVER w, 0) - 1) * 100 AS r FROM m WINDOW w AS (PARTITION BY k ORDER BY ts, id)),
s(k, i, e, ev, pk, seen, de, di, dv, dp, dx) AS (SELECT k, i, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM x WHERE i = 0 UNION ALL
SELECT k, i, CASE WHEN r IS NULL THEN e WHEN e IS NULL THEN CASE WHEN r > 50 THEN i END WHEN NOT over THEN e END, CASE WHEN r IS NULL THEN ev WHEN e IS NULL THEN CASE WHEN r > 50 THEN v END WHEN NOT over THEN ev END,
CASE WHEN r IS NULL THEN pk WHEN e IS NULL THEN CASE WHEN r > 50 THEN v END ELSE top END, CASE WHEN gap AND old IS NOT NULL THEN false WHEN r IS NOT NULL AND e IS NOT NULL AND over THEN true END,
old, CASE WHEN gap THEN i - 1 ELSE i END, ev, CASE WHEN gap THEN pk ELSE top END, CASE WHEN gap THEN pv ELSE v END FROM
(SELECT x.*, CASE WHEN x.gap THEN NULL ELSE s.e END AS e, s.e AS old, s.ev, s.pk, greatest(s.pk, x.v) AS top, x.v < s.ev OR (1 - x.v / greatest(s.pk, x.v)) * 100 > 60 AS over FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)),
z AS (SELECT s.k, s.e AS de, s.i AS di, s.ev AS dv, s.pk AS dp, x.v AS dx, false AS seen FROM s JOIN x USING (k, i) WHERE s.e IS NOT NULL AND s.i = (SELECT max(i) FROM x y WHERE y.k = s.k) AND x.ms + {IDLE} < (SELECT max(ms) - {DELAY} FROM x)),
a AS (SELECT k, de, di, dv, dp, dx, seen FROM s WHERE seen IS NOT NULL UNION ALL SELECT k, de, di, dv, dp, dx, seen FROM z)
SELECT k, de AS entry_idx, di AS exit_idx, di - de AS duration, dv AS entry_value, dp AS peak_value, dx AS exit_value, seen AS observed FROM a WHERE di - de >= 2""", "entry_value peak_value exit_value")
def ss12_stream_censored_episodes(spark, d):
    """Episodes of users that fall silent for 8 hours are censored, by their next row or by a timer once the watermark passes."""
    return stated(M.stream_timed(growth_stream(spark, d), "k", ORDER, M.Episodes, idle_ms=IDLE, **EPISODE), "ss12c")


@query(f"""WITH RECURSIVE {BARS_U}, x AS (SELECT k, i, v, coalesce(vol > 70, false) AS en, epoch_us(ts) // 1000 AS ms, lag(v) OVER (PARTITION BY k ORDER BY ts, id) AS pv FROM bars_u),
s(k, i, e, since, ev, pk, why, oe, oi, oev, oxv, opk, xms) AS (SELECT k, i, CASE WHEN en THEN i END, CASE WHEN en THEN ms END, CASE WHEN en THEN v END, CASE WHEN en THEN v END, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT FROM x WHERE i = 0 UNION ALL
SELECT k, i, CASE WHEN NOT held THEN CASE WHEN en THEN i END WHEN why IS NULL THEN e END, CASE WHEN NOT held THEN CASE WHEN en THEN ms END WHEN why IS NULL THEN since END, CASE WHEN NOT held THEN CASE WHEN en THEN v END WHEN why IS NULL THEN ev END, CASE WHEN NOT held THEN CASE WHEN en THEN v END WHEN why IS NULL THEN top END,
why, e, CASE WHEN late THEN i - 1 ELSE i END, ev, CASE WHEN late THEN pv ELSE v END, CASE WHEN late THEN pk ELSE top END, CASE WHEN late THEN since + {HOLD} ELSE ms END FROM
(SELECT *, e IS NOT NULL AND NOT late AS held, CASE WHEN late THEN 'time_stop' WHEN e IS NOT NULL AND (1 - v / top) * 100 > 40 THEN 'trailing_stop' END AS why FROM
(SELECT x.*, s.e, s.since, s.ev, s.pk, greatest(s.pk, x.v) AS top, coalesce(s.since + {HOLD} < x.ms, false) AS late FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1))),
z AS (SELECT s.k, s.e AS oe, s.i AS oi, s.ev AS oev, x.v AS oxv, s.pk AS opk, s.since + {HOLD} AS xms, 'time_stop' AS why FROM s JOIN x USING (k, i) WHERE s.e IS NOT NULL AND s.i = (SELECT max(i) FROM x y WHERE y.k = s.k) AND s.since + {HOLD} < (SELECT max(ms) - {DELAY} FROM x)),
a AS (SELECT k, oe, oi, oev, oxv, opk, xms, why FROM s WHERE why IS NOT NULL UNION ALL SELECT k, oe, oi, oev, oxv, opk, xms, why FROM z)
SELECT k, oe AS entry_idx, oi AS exit_idx, oev AS entry_value, oxv AS exit_value, opk AS peak_value, xms AS exit_ms, why AS exit_reason FROM a""", "entry_value exit_value peak_value")
def ss8_stream_timed_positions(spark, d):
    """Positions that are closed 12 hours after their entry, with or without a new row."""
    t = ticks(spark, d).select("k", "ts", "id", "v", (F.col("vol") > 70).alias("signal")).withWatermark("ts", "10 minutes")
    return stated(M.stream_timed(t, "k", ORDER, M.TimedPositions, v="v", signal="signal", stop=40.0, hold_ms=HOLD), "ss8t")


@query(f"""WITH RECURSIVE {TICKS}, x AS (SELECT k % 8 AS p, k::VARCHAR AS token, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY k % 8 ORDER BY ts, id) AS i FROM ticks),
s(p, i, held, gone, pushed, token, ms) AS (SELECT DISTINCT p, 0::BIGINT, []::STRUCT(since BIGINT, token VARCHAR)[], []::STRUCT(since BIGINT, token VARCHAR)[], NULL::STRUCT(since BIGINT, token VARCHAR), NULL::VARCHAR, NULL::BIGINT FROM x UNION ALL
SELECT p, i, CASE WHEN new THEN list_append(list_filter(live, lambda h: NOT coalesce(h = pushed, false)), {{'since': ms, 'token': token}}) ELSE live END, gone, pushed, CASE WHEN new THEN token END, ms FROM
(SELECT *, CASE WHEN new AND len(live) >= 6 THEN list_sort(live)[1] END AS pushed FROM (SELECT *, NOT list_contains(list_transform(live, lambda h: h.token), token) AS new FROM
(SELECT x.*, list_filter(s.held, lambda h: h.since + {TTL} >= x.ms) AS live, list_filter(s.held, lambda h: h.since + {TTL} < x.ms) AS gone FROM s JOIN x ON x.p = s.p AND x.i = s.i + 1)))),
z AS (SELECT p, unnest(held) AS h FROM s WHERE i = (SELECT max(i) FROM s y WHERE y.p = s.p)),
a AS (SELECT p, h.token, h.since + {TTL} AS at_ms, 'expired' AS change FROM (SELECT p, unnest(gone) AS h FROM s) UNION ALL SELECT p, pushed.token, ms, 'full' FROM s WHERE pushed IS NOT NULL UNION ALL SELECT p, token, ms, 'added' FROM s WHERE token IS NOT NULL
UNION ALL SELECT p, h.token, h.since + {TTL}, 'expired' FROM z WHERE h.since + {TTL} < (SELECT max(ms) - {DELAY} FROM x)) SELECT * FROM a""")
def ss11_stream_watch_log(spark, d):
    """Users dealt to 8 lists of 6 entries that leave after 12 hours of event time: the log of changes."""
    t = ticks(spark, d).select((F.col("k") % 8).alias("p"), "ts", "id", F.col("k").alias("token")).withWatermark("ts", "10 minutes")
    return stated(M.stream_timed(t, "p", ORDER, M.Watchlist, token="token", max_size=6, ttl_ms=TTL), "ss11w")


@query(f"WITH {TICKS} SELECT kind, count(*) AS n FROM ticks GROUP BY kind")
def ss13_stream_log(spark, d):
    at = landing(spark, "ss13")
    W.stream_log(ticks(spark, d).select("kind", "id"), f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/log").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT k, last(id ORDER BY ts, id) AS id, round(last(v ORDER BY ts, id) / 500, 4) AS score FROM ticks GROUP BY k", "score", 3)
def ss14_stream_rescore(spark, d):
    """Latest state of each key, scored in every micro-batch and upserted into buckets."""
    from ..operators.topk import latest_per_key
    from ..sources.keyed import KeyedTable

    def score(batch: DataFrame) -> DataFrame:
        return latest_per_key(batch, "k", ["ts", "id"]).withColumn("score", F.round(F.col("v") / 500, 4))

    at = landing(spark, "ss14")
    rows = ticks(spark, d).select("k", "ts", "id", "v")
    table = KeyedTable(spark, f"{at}/table", ["k"], "ts", rows.withColumn("score", F.col("v")).schema)
    W.stream_keyed(rows, table, f"{at}/checkpoint", score).awaitTermination()
    return table.read().select("k", "id", "score")
