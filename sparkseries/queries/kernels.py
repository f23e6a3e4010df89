"""Kernel operators on the driver's tables. SQL where a recurrence or list form exists; tests hold the rest to brute force."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import Series
from ..kernels import trades as R
from ..operators import features as X
from ..operators import joins as J
from ..operators import kernels as K
from ..operators import rules as Q
from ..operators import stats as A
from ..operators import warping as D
from ..operators.rules import Rule
from ..functions.scalars import hash_split
from . import ORACLE_SQL, query
from .clean import SPLIT
from .stats import STAT_FLOATS, STATS
from .views import BARS_H, BARS_U, H, U, bars_h, bars_u, position_sql

O = ["ts", "id"]


def hours(spark, d):
    """Hourly bars with numbers, growth, relative volume and holder-like columns."""
    b = bars_h(spark, d).withColumn("i", H.idx().cast("bigint"))
    return b.withColumns({"roc": H.roc("c", 6, percent=True), "rvol": H.rvol("vol", 48), "accel": F.coalesce(H.roc_accel("c", 6, 3, percent=True), F.lit(0.0)), "hold": H.cumulative("n")})


@query(f"""WITH {BARS_U}, l AS (SELECT k, list(v ORDER BY ts, id) AS vs, list(id ORDER BY ts, id) AS ids FROM bars_u GROUP BY k),
e AS (SELECT k, unnest(ids) AS id, unnest(list_transform(range(1, len(vs) + 1), lambda n: list_reduce(list_slice(vs, 1, n), lambda a, x: a + (x - a) * 2.0 / 14))) AS ema_13 FROM l) SELECT * FROM e""", "ema_13")
def wn15_ema(spark, d):
    b = bars_u(spark, d)
    return K.indicators(b, "k", O, "v", "i").join(b.select("k", "i", "id"), ["k", "i"]).select("k", "id", "ema_13")


def indicator(spark, d, *cols):
    b = bars_h(spark, d).withColumn("i", H.idx().cast("bigint"))
    return K.indicators(b, "k", ["ts"], "c", "i").select("k", "i", *cols)


HOURS = f"{BARS_H}, b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i FROM bars_h), x AS (SELECT k, i, c, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM b WINDOW w AS (PARTITION BY k ORDER BY i))"


def two_pole(period: float) -> tuple[float, float, float]:
    """Weights of the smoother's input and of its last two outputs."""
    r = math.exp(-math.sqrt(2) * math.pi / period)
    b1 = 2 * r * math.cos(math.sqrt(2) * math.pi / period)
    return 1 - b1 + r * r, b1, -r * r


def roofing_sql(high: int, low: int) -> str:
    """Rows (k, i, hp, hp1, y, y1, o) of the roofing filter y and the regime o that is smoothed from it."""
    w = 0.707 * 2 * math.pi / high
    t = 1 - (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    g, b1, b2 = two_pole(low)
    hp = f"{((1 + t) / 2) ** 2!r} * (x.c - 2 * x.c1 + x.c2) + {2 * t!r} * s.hp - {t * t!r} * s.hp1"
    return f"""WITH RECURSIVE {HOURS}, s(k, i, hp, hp1, y, y1, o) AS (SELECT k, i, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM x WHERE i = 0 UNION ALL
SELECT k, i, hp, hp1, y, y1, CASE WHEN y * y + y1 * y1 > 0 THEN 0.67 * least(1, greatest(-1, y / sqrt((y * y + y1 * y1) / 2))) ELSE 0 END + 0.33 * o FROM
(SELECT k, i, hp, hp1, CASE WHEN i < 2 THEN 0 ELSE {g!r} * (hp + hp1) / 2 + {b1!r} * y + {b2!r} * y1 END AS y, y AS y1, o FROM
(SELECT x.k, x.i, CASE WHEN x.i < 2 THEN 0 ELSE {hp} END AS hp, s.hp AS hp1, s.y, s.y1, s.o FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)))"""


@query(f"{roofing_sql(48, 10)} SELECT k, i, y AS roofing FROM s", "roofing")
def h1_roofing(spark, d):
    return indicator(spark, d, "roofing")


@query(f"""WITH RECURSIVE {HOURS}, p AS (SELECT k, i, c, min(c) OVER w AS lo, max(c) OVER w AS hi FROM x WINDOW w AS (PARTITION BY k ORDER BY i ROWS 9 PRECEDING)),
s(k, i, z, f) AS (SELECT k, i, 0::DOUBLE, 0::DOUBLE FROM p WHERE i = 0 UNION ALL SELECT k, i, z, CASE WHEN i < 10 THEN 0 ELSE (0.5 * ln((1 + z) / (1 - z)) + f) / 2 END FROM
(SELECT p.k, p.i, CASE WHEN p.i < 10 THEN 0 ELSE least(0.999, greatest(-0.999, 0.33 * CASE WHEN hi > lo THEN 2 * ((p.c - lo) / (hi - lo) - 0.5) ELSE 0 END + 0.67 * s.z)) END AS z, s.f FROM s JOIN p ON p.k = s.k AND p.i = s.i + 1))
SELECT k, i, f AS fisher, lag(f) OVER (PARTITION BY k ORDER BY i) AS fisher_signal FROM s""", "fisher fisher_signal")
def h2_fisher(spark, d):
    return indicator(spark, d, "fisher", "fisher_signal")


@query(f"{roofing_sql(40, 10)} SELECT k, i, o AS ebsw FROM s", "ebsw")
def h3_sinewave(spark, d):
    return indicator(spark, d, "ebsw")


ITREND = f"""WITH RECURSIVE {HOURS}, s(k, i, y, y1) AS (SELECT k, i, c, 0::DOUBLE FROM x WHERE i = 0 UNION ALL
SELECT x.k, x.i, CASE WHEN x.i < 2 THEN x.c ELSE {two_pole(10)[0]!r} * (x.c + x.c1) / 2 + {two_pole(10)[1]!r} * s.y + {two_pole(10)[2]!r} * s.y1 END, s.y FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)
SELECT s.k, s.i, y AS itrend, CASE WHEN s.i < 2 THEN y ELSE 2 * y - lag(y, 2) OVER (PARTITION BY s.k ORDER BY s.i) END AS itrend_trigger, CAST(x.c > y AS INT) AS above_itrend FROM s JOIN x ON x.k = s.k AND x.i = s.i"""


@query(ITREND, "itrend itrend_trigger")
def h4_itrend(spark, d):
    return indicator(spark, d, "itrend", "itrend_trigger", "above_itrend")


@query(f"""WITH {HOURS}, n(n) AS (VALUES (4), (6), (9), (13), (19)), p AS (SELECT x.k, x.i, y.c, y.i - x.i + 48 AS j FROM x JOIN x AS y ON y.k = x.k AND y.i BETWEEN x.i - 48 AND x.i - 1 WHERE x.i >= 48 AND x.i % 12 = 0),
g AS (SELECT k, i, n, j // n AS g, j, c FROM p, n WHERE j < (48 // n) * n), m AS (SELECT *, c - avg(c) OVER (PARTITION BY k, i, n, g) AS e, stddev_samp(c) OVER (PARTITION BY k, i, n, g) AS sd FROM g),
y AS (SELECT *, sum(e) OVER (PARTITION BY k, i, n, g ORDER BY j) AS y FROM m), r AS (SELECT k, i, n, g, (max(y) - min(y)) / max(sd) AS rs FROM y WHERE sd > 0 GROUP BY ALL), q AS (SELECT k, i, n, ln(avg(rs)) AS ly FROM r GROUP BY ALL),
h AS (SELECT k, i, CASE WHEN count(*) < 3 THEN 0.5 ELSE least(1, greatest(0, regr_slope(ly, ln(n)))) END AS h FROM q GROUP BY k, i)
SELECT x.k, x.i, coalesce(last_value(h.h IGNORE NULLS) OVER (PARTITION BY x.k ORDER BY x.i), 0.5) AS hurst FROM x LEFT JOIN h ON h.k = x.k AND h.i = x.i""", "hurst")
def h5_rolling_hurst(spark, d):
    return indicator(spark, d, "hurst")


@query(f"""SELECT * FROM (WITH RECURSIVE {HOURS}, s(k, i, fast, slow, line) AS (SELECT k, i, c, c, 0::DOUBLE FROM x WHERE i = 0 UNION ALL
SELECT k, i, fast, slow, line + (fast - slow - line) * (2.0 / 6) FROM (SELECT x.k, x.i, s.fast + (x.c - s.fast) * (2.0 / 7) AS fast, s.slow + (x.c - s.slow) * (2.0 / 14) AS slow, s.line FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1))
SELECT k, i, slow AS ema_13, fast - slow AS macd, line AS macd_signal, fast - slow - line AS macd_hist, coalesce(fast - slow - line - lag(fast - slow - line) OVER (PARTITION BY k ORDER BY i), 0) AS macd_slope FROM s) JOIN
(WITH {HOURS} SELECT k, i, (c / nullif(lag(c, 6) OVER w, 0) - 1) * 100 AS roc, vol / nullif(avg(vol) OVER (PARTITION BY k ORDER BY i ROWS 47 PRECEDING), 0) AS rvol,
coalesce(c / nullif(lag(c, 6) OVER w, 0) - lag(c, 3) OVER w / nullif(lag(c, 9) OVER w, 0), 0) * 100 AS accel, sum(buy - sell) OVER w6 / nullif(sum(buy + sell) OVER w6, 0) AS ofi, sum(buy) OVER w6 / nullif(sum(sell) OVER w6, 0) AS bs_ratio
FROM b WINDOW w AS (PARTITION BY k ORDER BY i), w6 AS (PARTITION BY k ORDER BY i ROWS 5 PRECEDING)) USING (k, i) {' '.join(f'JOIN ({ORACLE_SQL[n]}) USING (k, i)' for n in ('h1_roofing', 'h2_fisher', 'h3_sinewave', 'h4_itrend', 'h5_rolling_hurst'))}""",
"ema_13 macd macd_signal macd_hist macd_slope roc rvol accel ofi bs_ratio")
def wn31_all_indicators(spark, d):
    """Window and recursive indicators together (also H1 to H5 and MACD)."""
    b = hours(spark, d)
    return b.select("k", "i", "roc", "rvol", "accel", H.ofi("buy", "sell", 6).alias("ofi"), H.flow_ratio("buy", "sell", 6).alias("bs_ratio")).join(K.indicators(b, "k", ["ts"], "c", "i"), ["k", "i"])


@query(f"""WITH RECURSIVE {BARS_U}, m AS (SELECT k, avg(v) AS m, stddev_pop(v - 0) AS s FROM bars_u GROUP BY k), x AS (SELECT k, i, v - m AS z, s FROM bars_u JOIN m USING (k)),
c(k, i, up, down, alarm) AS (SELECT k, i, 0::DOUBLE, 0::DOUBLE, false FROM x WHERE i = 0 UNION ALL
SELECT x.k, x.i, CASE WHEN greatest(0, c.up + z - 0.1 * s) > 2 * s THEN 0 ELSE greatest(0, c.up + z - 0.1 * s) END, CASE WHEN least(0, c.down + z + 0.1 * s) < -2 * s THEN 0 ELSE least(0, c.down + z + 0.1 * s) END, least(0, c.down + z + 0.1 * s) < -2 * s FROM c JOIN x ON x.k = c.k AND x.i = c.i + 1)
SELECT * FROM c""", "up down", 4)
def h6_cusum(spark, d):
    b = bars_u(spark, d).withColumn("z", F.col("v") - F.avg("v").over(U.all))
    return K.cusum(b, "k", O, "z", "i", 2.0, 0.1)


@query()
def h7_kalman_trend(spark, d):
    return K.kalman_trend(bars_u(spark, d), "k", O, "v", "i")


@query()
def h8_momentum_signals(spark, d):
    return K.momentum_signals(bars_h(spark, d).withColumn("i", H.idx().cast("bigint")), "k", ["ts"], "c", "i")


@query()
def h9_hmm_regime(spark, d):
    return K.hmm_regime(bars_u(spark, d), "k", O, "v", "i")


def growth(spark, d):
    """Series with log returns and growth of volume, without the first row, and the pooled model's posterior."""
    b = bars_u(spark, d).withColumns({"lr": F.log(F.greatest("v", F.lit(1.0))) - F.log(F.greatest(U.lag("v"), F.lit(1.0))), "lv": F.log1p("vol") - F.log1p(U.lag("vol"))}).fillna(0.0, ["lr", "lv"])
    model = K.fit_pooled_hmm(b, "k", O, ["lr", "lv"], rounds=4)
    return b.join(K.hmm_posterior(b, "k", O, ["lr", "lv"], "i", model), ["k", "i"])


#: A given model of two states: (start, mean, deviation) of log growth in each, and the probability to stay.
GIVEN, STAY = ((0.6, -0.1, 1.2), (0.4, 0.3, 0.5)), 0.8


def _density(x: str, j: int) -> str:
    return f"exp(-0.5 * ({x} - {GIVEN[j][1]}) ** 2 / {GIVEN[j][2]} ** 2) / {GIVEN[j][2]}"


@query(f"""WITH RECURSIVE {BARS_U}, x AS (SELECT k, i, coalesce(ln(greatest(v, 1)) - ln(greatest(lag(v) OVER (PARTITION BY k ORDER BY ts, id), 1)), 0) AS r FROM bars_u),
s(k, i, a, b) AS (SELECT k, i, p / (p + q), q / (p + q) FROM (SELECT k, i, {GIVEN[0][0]} * {_density('r', 0)} AS p, {GIVEN[1][0]} * {_density('r', 1)} AS q FROM x WHERE i = 0) UNION ALL
SELECT k, i, p / (p + q), q / (p + q) FROM (SELECT x.k, x.i, (s.a * {STAY} + s.b * {1 - STAY:.1f}) * {_density('x.r', 0)} AS p, (s.a * {1 - STAY:.1f} + s.b * {STAY}) * {_density('x.r', 1)} AS q FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1))
SELECT k, i, b AS growth FROM s""", "growth")
def h10_forward_filter(spark, d):
    """P(growth state) up to each row under a given model."""
    b = bars_u(spark, d).withColumn("lr", F.coalesce(F.log(F.greatest("v", F.lit(1.0))) - F.log(F.greatest(U.lag("v"), F.lit(1.0))), F.lit(0.0)))
    model = {"start": np.array([g[0] for g in GIVEN]), "move": np.array([[STAY, 1 - STAY], [1 - STAY, STAY]]), "mean": np.array([[g[1]] for g in GIVEN]), "cov": np.array([[[g[2] ** 2]] for g in GIVEN])}
    return K.hmm_filter(b, "k", O, ["lr"], "i", model)


@query()
def h10_pooled_hmm(spark, d):
    return growth(spark, d).select("k", "i", "growth")


@query(f"""WITH {BARS_U}, p AS (SELECT k, i, ln(1 + v) AS lv, h::DOUBLE AS h FROM bars_u), e AS (SELECT *, sqrt((lv - lag(lv) OVER w) ** 2 + (h - lag(h) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY k ORDER BY i)),
g AS (SELECT k, i, lv, h, coalesce(sum(step) OVER w, 0) AS arc, lead(lv) OVER w AS lv1, lead(h) OVER w AS h1, lead(step) OVER w AS step1 FROM e WINDOW w AS (PARTITION BY k ORDER BY i)),
q AS (SELECT k, j, z * j / 15 AS arc FROM (SELECT k, max(arc) AS z FROM g GROUP BY k), (SELECT unnest(range(16)) AS j))
SELECT q.k, CAST(j AS INT) AS j, g.lv + coalesce(least(1, (q.arc - g.arc) / nullif(step1, 0)) * (lv1 - g.lv), 0) AS lv, g.h + coalesce(least(1, (q.arc - g.arc) / nullif(step1, 0)) * (h1 - g.h), 0) AS h FROM q ASOF JOIN g ON g.k = q.k AND g.arc <= q.arc""", "lv h")
def h11_resampled_paths(spark, d):
    p = K.resampled(bars_u(spark, d).withColumn("lv", F.log1p("v")), "k", O, ["lv", "h"], 16)
    return p.select("k", F.posexplode("path").alias("j", "p")).select("k", "j", F.col("p")[0].alias("lv"), F.col("p")[1].alias("h"))


@query(f"""WITH {BARS_U}, g AS (SELECT k, i, v / 100 AS v, i / (max(i) OVER (PARTITION BY k))::DOUBLE AS t FROM bars_u), e AS (SELECT k, i, t - lag(t) OVER w AS dt, v - lag(v) OVER w AS dv, lag(t) OVER w - first(t) OVER w AS pt, lag(v) OVER w - first(v) OVER w AS pv FROM g WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k, sum(dt) AS s1, sum(dv) AS s2, sum(pt * dv + dt * dv / 2) AS s12, sum(pv * dt + dt * dv / 2) AS s21 FROM e GROUP BY k""", "s1 s2 s12 s21", 8)
def h12_signature(spark, d):
    """Levels 1 and 2 against SQL; tests check level 3 by its shuffle identities."""
    s = K.signatures(bars_u(spark, d).withColumn("v", F.col("v") / 100), "k", O, ["v"])
    return s.select("k", F.col("sig")[0].alias("s1"), F.col("sig")[1].alias("s2"), F.col("sig")[3].alias("s12"), F.col("sig")[4].alias("s21"))


@query(f"""WITH {BARS_U}, p AS (SELECT k, i, unnest([0, 1, 2]) AS a, unnest([i::DOUBLE, v / 100, h::DOUBLE]) AS x FROM bars_u), e AS (SELECT k, i, a, x - lag(x) OVER w AS e, lag(x) OVER w - first(x) OVER w AS s FROM p WINDOW w AS (PARTITION BY k, a ORDER BY i)),
d AS (SELECT a.k, a.i, a.a, b.a AS b, a.s, a.e AS ea, b.e AS eb, sum(a.s * b.e + a.e * b.e / 2) OVER (PARTITION BY a.k, a.a, b.a ORDER BY a.i) AS s2 FROM e AS a JOIN e AS b ON b.k = a.k AND b.i = a.i WHERE a.i > 0),
l AS (SELECT *, coalesce(lag(s2) OVER (PARTITION BY k, a, b ORDER BY i), 0) AS was FROM d), t AS (SELECT l.k, l.i, l.a, l.b, c.a AS c, sum(was * c.e + l.s * eb * c.e / 2 + ea * eb * c.e / 6) OVER (PARTITION BY l.k, l.a, l.b, c.a ORDER BY l.i) AS s3 FROM l JOIN e AS c ON c.k = l.k AND c.i = l.i),
u AS (SELECT k, i, s + e AS s, (a = 0)::INT AS n FROM e WHERE i > 0 UNION ALL SELECT k, i, s2, (a = 0)::INT + (b = 0)::INT FROM d UNION ALL SELECT k, i, s3, (a = 0)::INT + (b = 0)::INT + (c = 0)::INT FROM t)
SELECT k, CAST(i + 1 AS INT) AS len, ln(1 + sum((s / i ** n) ** 2)) AS log_energy FROM u WHERE i > 1 GROUP BY k, i""", "log_energy")
def h12_prefix_norms(spark, d):
    """Logarithm of 1 + the squared norm of each prefix's signature (its values reach up to 1e9)."""
    return prefix_energy(spark, d).select("k", "len", F.log1p("energy").alias("log_energy"))


@query()
def h12_prefix_signatures(spark, d):
    return prefix_energy(spark, d)


def prefix_energy(spark, d):
    s = K.prefix_signatures(bars_u(spark, d).withColumn("v", F.col("v") / 100), "k", O, ["v", "h"])
    return s.select("k", "len", F.aggregate("sig", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


def short_paths(spark, d):
    return K.resampled(bars_u(spark, d).withColumn("lv", F.log1p("v")), "k", O, ["lv"], 8, "linear")


def dtw_sql(name: str, points: str, n: int) -> str:
    """Recursive table ``name``(a, b, r, d): after row r of the warping table of two lists of n numbers, d has its row after a cell at the edge."""
    return f"""{name}(a, b, r, d) AS (SELECT x.k, y.k, 0, list_prepend(0::DOUBLE, list_transform(range({n}), lambda j: 'inf'::DOUBLE)) FROM {points} AS x JOIN {points} AS y ON y.k > x.k UNION ALL
SELECT s.a, s.b, s.r + 1, list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, {n + 1}), lambda j: [abs(x.p[s.r + 1] - y.p[j]), s.d[j], s.d[j + 1]])), lambda row, c: list_append(row, c[1] + least(c[2], c[3], row[len(row)])))
FROM {name} AS s JOIN {points} AS x ON x.k = s.a JOIN {points} AS y ON y.k = s.b WHERE s.r < {n})"""


PATHS = f"""{BARS_U}, g AS (SELECT k, list(ln(1 + v) ORDER BY i) AS l FROM bars_u GROUP BY k), p AS (SELECT k, list_transform(range(8), lambda j: l[floor((len(l) - 1) * j / 7)::INT + 1] * (1 - ((len(l) - 1) * j / 7 - floor((len(l) - 1) * j / 7))) + coalesce(l[floor((len(l) - 1) * j / 7)::INT + 2], 0) * ((len(l) - 1) * j / 7 - floor((len(l) - 1) * j / 7))) AS p FROM g),
o AS (SELECT k, list_transform(range(1, 8), lambda j: p[j + 1] - p[j]) AS p FROM p)"""


@query(f"WITH RECURSIVE {PATHS}, {dtw_sql('s', 'p', 8)} SELECT a, b, d[9] AS distance FROM s WHERE r = 8", "distance")
def h13_dtw_pairs(spark, d):
    return K.pairwise(A.written_once(short_paths(spark, d)), "k", "path")


@query(f"""WITH RECURSIVE {PATHS}, {dtw_sql('s', 'p', 8)}, f AS (SELECT a AS query, b AS neighbour, d[9] AS distance FROM s WHERE r = 8 UNION ALL SELECT b, a, d[9] FROM s WHERE r = 8)
SELECT query, neighbour, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM f WHERE query % 10 = 0 QUALIFY rank <= 3""", "distance")
def h13_nearest_paths(spark, d):
    """The three nearest paths of every tenth user; lower bounds spare most warpings."""
    p = A.written_once(short_paths(spark, d))
    return D.nearest_paths(p.where("k % 10 = 0"), p, "k", "path", 3).select("query", "neighbour", "distance", "rank")


@query(f"""WITH RECURSIVE {PATHS}, {dtw_sql('s', 'p', 8)}, {dtw_sql('u', 'o', 7)}, f AS (SELECT s.a, s.b, 0.5 * s.d[9] / 16 + 0.5 * u.d[8] / 14 AS f FROM s JOIN u ON u.a = s.a AND u.b = s.b AND u.r = 7 WHERE s.r = 8),
m AS (SELECT a, CAST(b % 3 AS INT) AS label, avg(f) AS m FROM (SELECT a, b, f FROM f UNION ALL SELECT b, a, f FROM f) GROUP BY ALL) SELECT a AS k, first(label ORDER BY m, label) AS nearest, min(m) AS mean_distance FROM m GROUP BY a""", "mean_distance")
def jn17_pairwise(spark, d):
    """All pairs under the blended shape distance, in blocks that hand on sums, and each key's nearest class."""
    p = A.written_once(short_paths(spark, d)).withColumn("label", (F.col("k") % 3).cast("int"))
    return K.classify_by_paths(p, "k", "path", "label")


EPI = f"""WITH RECURSIVE {BARS_U}, x AS (SELECT k, i, v, (v / nullif(lag(v, 2) OVER (PARTITION BY k ORDER BY ts, id), 0) - 1) * 100 AS r FROM bars_u),
s(k, i, e, ev, pk, done, de, dv, dp, dx) AS (SELECT k, i, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, false, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM x WHERE i = 0 UNION ALL
SELECT x.k, x.i, CASE WHEN x.r IS NULL THEN s.e WHEN s.e IS NULL THEN CASE WHEN x.r > 50 THEN x.i END WHEN x.v < s.ev OR (1 - x.v / greatest(s.pk, x.v)) * 100 > 60 THEN NULL ELSE s.e END,
CASE WHEN x.r IS NULL THEN s.ev WHEN s.e IS NULL THEN CASE WHEN x.r > 50 THEN x.v END WHEN x.v < s.ev OR (1 - x.v / greatest(s.pk, x.v)) * 100 > 60 THEN NULL ELSE s.ev END,
CASE WHEN x.r IS NULL THEN s.pk WHEN s.e IS NULL THEN CASE WHEN x.r > 50 THEN x.v END ELSE greatest(s.pk, x.v) END,
x.r IS NOT NULL AND s.e IS NOT NULL AND (x.v < s.ev OR (1 - x.v / greatest(s.pk, x.v)) * 100 > 60), s.e, s.ev, greatest(s.pk, x.v), x.v FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)"""


@query(f"""{EPI} SELECT k, CAST(de AS INT) AS entry_idx, CAST(i AS INT) AS exit_idx, CAST(i - de AS INT) AS duration, dv AS entry_value, dp AS peak_value, dx AS exit_value FROM s WHERE done AND i - de >= 2""", "entry_value peak_value exit_value")
def h14_episodes(spark, d):
    b = bars_u(spark, d).withColumn("roc", U.roc("v", 2, percent=True))
    return K.episodes(b, "k", O, "v", "roc", min_roc=50.0, max_fall=60.0, min_bars=2).where("observed").select("k", "entry_idx", "exit_idx", "duration", "entry_value", "peak_value", "exit_value")


def all_episodes(spark, d):
    b = bars_u(spark, d).withColumn("roc", U.roc("v", 2, percent=True))
    return K.episodes(b, "k", O, "v", "roc", min_roc=50.0, max_fall=60.0, min_bars=1)


@query()
def h15_cox_ph(spark, d):
    e = all_episodes(spark, d).withColumn("lr", F.log1p("initial_roc"))
    fit = K.cox_ph(e, "duration", "observed", ["lr", "entry_value"])
    risk = fit["coef"]["lr"] * F.col("lr") + fit["coef"]["entry_value"] * F.col("entry_value")
    return e.select("k", "entry_idx", risk.alias("log_hazard"))


@query(f"""WITH RECURSIVE {BARS_U}, x AS (SELECT k, i, v, v > 1.2 * lag(v) OVER w AS en, v < 0.5 * lag(v) OVER w AS ex, max(i) OVER (PARTITION BY k) AS z FROM bars_u WINDOW w AS (PARTITION BY k ORDER BY ts, id)),
s(k, i, e, ev, de, dv, closed) AS (SELECT k, i, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, false FROM x WHERE i = 0 UNION ALL
SELECT x.k, x.i, CASE WHEN s.e IS NULL THEN CASE WHEN x.en THEN x.i END WHEN x.ex THEN NULL ELSE s.e END, CASE WHEN s.e IS NULL THEN CASE WHEN x.en THEN x.v END WHEN x.ex THEN NULL ELSE s.ev END, s.e, s.ev, s.e IS NOT NULL AND x.ex FROM s JOIN x ON x.k = s.k AND x.i = s.i + 1)
SELECT s.k, CAST(de AS INT) AS entry_idx, CAST(s.i AS INT) AS exit_idx, (x.v / dv - 1) * 100 AS return_pct FROM s JOIN x ON x.k = s.k AND x.i = s.i WHERE closed
UNION ALL SELECT s.k, CAST(e AS INT), CAST(s.i AS INT), (x.v / ev - 1) * 100 FROM s JOIN x ON x.k = s.k AND x.i = s.i WHERE e IS NOT NULL AND s.i = z""", "return_pct")
def h16_signal_trades(spark, d):
    b = bars_u(spark, d).withColumns({"en": F.coalesce(F.col("v") > 1.2 * U.lag("v"), F.lit(False)), "ex": F.coalesce(F.col("v") < 0.5 * U.lag("v"), F.lit(False))})
    return K.simulate(b, "k", O, ["v", "en", "ex"], lambda a: R.signal_trades(a["v"], a["en"], a["ex"])).select("k", "entry_idx", "exit_idx", "return_pct")


TRADE_SQL = """SELECT k, CAST(oe AS INT) AS entry_idx, CAST(i AS INT) AS exit_idx, oev AS entry_value, xv AS exit_value, opk AS peak_value, CAST(i - oe AS INT) AS bars_held, (xv / oev - 1) * 100 AS return_pct, (opk / oev - 1) * 100 AS peak_return_pct, why AS exit_reason FROM s WHERE why IS NOT NULL"""
TRADE_FLOATS = "entry_value exit_value peak_value return_pct peak_return_pct"


@query(f"""{position_sql(BARS_U + """, u AS (SELECT k, i, v, max(i) OVER (PARTITION BY k) AS z, greatest(v, 1) > greatest(lag(v) OVER w, 1) AS up, h > lag(h) OVER w AS more, h < lag(h) OVER w AS less FROM bars_u WINDOW w AS (PARTITION BY k ORDER BY ts, id)),
x AS (SELECT k, i, v, z, i >= 6 AND coalesce(bool_or(up) OVER w3, false) AND coalesce(bool_or(more) OVER w3, false) AS en, i >= 4 AND coalesce(bool_and(coalesce(less, false)) OVER w4, false) AS run FROM u WINDOW w3 AS (PARTITION BY k ORDER BY i ROWS 2 PRECEDING), w4 AS (PARTITION BY k ORDER BY i ROWS 3 PRECEDING))""",
"WHEN fall > 60 THEN 'trailing_stop' WHEN gain < -120 THEN 'hard_stop' WHEN bars >= 10 AND gain <= 0 THEN 'time_stop' WHEN run THEN 'holder_decline' WHEN i = z THEN 'end_of_data'")}, w AS (SELECT k, i FROM x WHERE i = z)
{TRADE_SQL} UNION ALL SELECT s.k, CAST(e AS INT), CAST(s.i AS INT), ev, ev, pk, 0, 0, 0, 'end_of_data' FROM s JOIN w ON w.k = s.k AND w.i = s.i WHERE e = s.i""", TRADE_FLOATS)
def h17_rule_trades(spark, d):
    c = R.RuleConfig(lookback=3, min_positive=1, stop=60.0, max_hold=10, max_share_fall=1e9)
    return K.simulate(bars_u(spark, d), "k", O, ["v", "h", "vol"], lambda a: R.rule_trades(a["v"], a["h"].astype(float), a["vol"], c))


@query()
def h18_regime_trades(spark, d):
    return K.simulate(growth(spark, d), "k", O, ["v", "growth"], lambda a: R.regime_trades(a["v"], a["growth"], R.RegimeConfig(0.6, 0.4, 50.0, 2, 3)))


def bar_inputs(spark, d):
    b = hours(spark, d)
    x = b.join(K.indicators(b, "k", ["ts"], "c", "i").select("k", "i", "ebsw", F.col("above_itrend").cast("double").alias("above")), ["k", "i"])
    return X.momentum_quality(x, "k", ["roc", "accel"]).withColumn("tighten", F.col("tighten_stop"))


BAR_COLS = ["c", "roc", "rvol", "accel", "ebsw", "above", "tighten"]


def run_bars(a, c, hazard=None):
    return R.bar_trades(a["c"], {n: a[n] for n in BAR_COLS[1:]}, hazard, c)


HAZARD = f"""{EPI}, z AS (SELECT k, max(i) AS i FROM x GROUP BY k), d AS (SELECT i - de AS duration, 1 AS o FROM s WHERE done UNION ALL SELECT s.i - e, 0 FROM s JOIN z ON z.k = s.k AND z.i = s.i WHERE e < s.i),
g AS (SELECT duration, sum(o) AS n, count(*) AS c FROM d GROUP BY duration), r AS (SELECT duration, n / sum(c) OVER (ORDER BY duration DESC) AS hazard FROM g)
SELECT list(coalesce(hazard, 0) ORDER BY j) AS hz FROM (SELECT unnest(range(max(duration) + 1)) AS j FROM r) LEFT JOIN r ON r.duration = j"""
BAR_ROWS = f"""{BARS_H}, w AS (SELECT k, row_number() OVER w - 1 AS i, c, (c / nullif(lag(c, 6) OVER w, 0) - 1) * 100 AS roc, vol / nullif(avg(vol) OVER (PARTITION BY k ORDER BY ts ROWS 47 PRECEDING), 0) AS rvol,
coalesce(c / nullif(lag(c, 6) OVER w, 0) - lag(c, 3) OVER w / nullif(lag(c, 9) OVER w, 0), 0) * 100 AS accel FROM bars_h WINDOW w AS (PARTITION BY k ORDER BY ts)), dev AS (SELECT k, stddev_samp(roc) AS sr, stddev_samp(accel) AS sa FROM w GROUP BY k),
q AS (SELECT w.*, roc IS NOT NULL AND coalesce(sr > 0, false) AS has_r, coalesce(sa > 0, false) AS has_a, greatest(-1, least(1, roc / sr)) AS qr, greatest(-1, least(1, accel / sa)) AS qa FROM w JOIN dev USING (k)),
wave AS ({roofing_sql(40, 10)} SELECT k, i, o FROM s), trend AS ({ITREND}), y AS (SELECT q.k, q.i, q.c AS v, q.roc, q.rvol, q.accel, NOT coalesce(wave.o < 0, false) AND trend.above_itrend <> 0 AND q.accel > 0 AND q.i >= 20 AND coalesce(lag(q.roc) OVER (PARTITION BY q.k ORDER BY q.i) > 0, false) AS ok, max(q.i) OVER (PARTITION BY q.k) AS z,
coalesce((CASE WHEN has_r THEN qr ELSE 0 END + CASE WHEN has_a THEN qa ELSE 0 END) / nullif(has_r::INT + has_a::INT, 0) < -0.5, false) AS tighten FROM q JOIN wave USING (k, i) JOIN trend USING (k, i))"""
BAR_RULES = "WHEN tighten AND bars >= 3 AND fall > tight THEN 'trailing_stop_tight' WHEN NOT tighten AND bars >= 3 AND fall > stop THEN 'trailing_stop' WHEN gain < -2 * stop THEN 'hard_stop' WHEN bars >= 3 AND roc < -2 * least_roc THEN 'momentum_collapse' WHEN i = z THEN 'end_of_data'"
OPEN_AT_END = "SELECT s.k, CAST(e AS INT), CAST(s.i AS INT), ev, ev, pk, 0, 0, 0, 'end_of_data' FROM s JOIN x ON x.k = s.k AND x.i = s.i WHERE e = s.i AND s.i = x.z"


@query(f"""{position_sql(BAR_ROWS + f", hz AS ({HAZARD}), x AS (SELECT y.*, 40 AS stop, 20 AS tight, 3 AS least_roc, hz, ok AND coalesce(roc > 3 AND rvol > 1.2, false) AS en FROM y, hz)",
"WHEN bars >= 3 AND hz[least(bars, len(hz) - 1) + 1] > 0.6 * CASE WHEN gain > 5 THEN 1.5 WHEN gain < -3 THEN 0.7 ELSE 1 END THEN 'hazard' " + BAR_RULES)} {TRADE_SQL} UNION ALL {OPEN_AT_END}""", TRADE_FLOATS)
def h19_bar_trades(spark, d):
    """Indicator strategy with the hazard of a survival curve of earlier episodes."""
    curve = A.kaplan_meier(all_episodes(spark, d)).orderBy("duration").toPandas()  # a row for each distinct duration
    hazard = np.zeros(int(curve["duration"].max()) + 1 if len(curve) else 1)
    hazard[curve["duration"].astype(int)] = curve["hazard"]
    return K.simulate(bar_inputs(spark, d), "k", ["ts"], BAR_COLS, lambda a: run_bars(a, R.BarConfig(hazard=0.6, stop=40, tight=20), hazard))


@query(f"""{position_sql(BARS_H + """, b AS (SELECT *, row_number() OVER w - 1 AS i, (c / nullif(lag(c, 6) OVER w, 0) - 1) * 100 AS roc, vol / nullif(avg(vol) OVER (PARTITION BY k ORDER BY ts ROWS 47 PRECEDING), 0) AS rvol FROM bars_h WINDOW w AS (PARTITION BY k ORDER BY ts)),
x AS (SELECT k, i, c AS v, roc, n >= 3 AS good, i >= 48 AND n >= 3 AND coalesce(roc > 2 AND rvol > 1.5, false) AND c > 0 AS en FROM b)""",
"WHEN gain >= 15 THEN 'take_profit' WHEN gain <= -8 THEN 'hard_stop' WHEN gain >= 5 AND fall >= 4 THEN 'trailing_stop' WHEN bars >= 24 THEN 'time_stop' WHEN roc < -3 THEN 'momentum_reversal' WHEN NOT good AND bars > 2 THEN 'state_exit'", 0.01)} {TRADE_SQL}""", TRADE_FLOATS)
def h20_scalp_trades(spark, d):
    b = hours(spark, d).withColumn("good", F.col("n") >= 3)
    return K.simulate(b, "k", ["ts"], ["c", "roc", "rvol", "good"], lambda a: R.scalp_trades(a["c"], a["roc"], a["rvol"], a["good"], R.ScalpConfig()))


W = "WINDOW w AS (PARTITION BY k ORDER BY i)"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def cases(rules: list[Rule], what: str) -> str:
    """SQL of the first rule that holds."""
    return "CASE " + " ".join(f"WHEN {r.when} THEN {r.part!r}" if what == "part" else f"WHEN {r.when} THEN '{r.action}'" for r in rules) + (" ELSE 0 END" if what == "part" else " ELSE 'HOLD' END")


def sales_sql(rows: str, part: str, key: str = "k", order: str = "i", action: str = "''") -> str:
    """Tables ``pos`` (gain, off_peak, best) and ``sales`` (before, sold, after) of positions over ``rows``."""
    w = f"PARTITION BY {key} ORDER BY {order}"
    return f"""{rows}, p0 AS (SELECT *, (v - first(v) OVER (w)) / greatest(first(v) OVER (w), 1) AS gain, CASE WHEN max(v) OVER (w) > 0 THEN v / max(v) OVER (w) - 1 ELSE 0 END AS off_peak FROM x WINDOW w AS ({w})),
pos AS (SELECT *, greatest(0, max(gain) OVER ({w})) AS best, max(gain) OVER ({w} {PRIOR}) AS hi, min(gain) OVER ({w} {PRIOR}) AS lo FROM p0), cut AS (SELECT *, {part} AS part, {action} AS wanted FROM pos),
was AS (SELECT *, greatest(0, 1 - coalesce(sum(part) OVER ({w} {PRIOR}), 0)) AS before FROM cut), sales AS (SELECT *, least(part, before) AS sold, before - least(part, before) AS after FROM was)"""


OUTCOME = "SELECT k, (sum(sold * gain) + last(after * gain ORDER BY i)) * 0.97 AS ret, CAST(count(*) FILTER (sold > 0) AS INT) AS n_sales FROM sales GROUP BY k"
LIFE_ROWS = f"""{BARS_U}, w AS (SELECT *, coalesce(coalesce(vol / nullif(avg(vol) OVER (PARTITION BY k ORDER BY i ROWS 23 PRECEDING), 0), 0) < 0.5, false) AS quiet, h / nullif(lag(h, 3) OVER w, 0) - 1 AS h3 FROM bars_u {W}),
g AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER w AS isle FROM w {W}), x AS (SELECT k, i, v, least(24, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY k, isle ORDER BY i)) AS dry, coalesce(v / nullif(lag(v, 4) OVER w, 0) - 1, 0) AS roc_4,
coalesce(h / nullif(lag(h, 6) OVER w, 0) - 1, 0) AS holders, coalesce(v / nullif(lag(v, 12) OVER w, 0) - 1, 0) AS roc_12, coalesce(h3 - lag(h3, 3) OVER w, 0) AS joining,
CASE WHEN i >= 11 THEN coalesce(avg(vol) OVER (PARTITION BY k ORDER BY i ROWS 5 PRECEDING) / nullif(avg(vol) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING), 0) - 1, 0) ELSE 0 END AS flow,
v / nullif(coalesce(sum(v * vol) OVER w12 / nullif(sum(vol) OVER w12, 0), v), 0) - 1 AS gap FROM g {W}, w12 AS (PARTITION BY k ORDER BY i ROWS 11 PRECEDING))"""
#: Rules by band of the value: silence ends small positions, falls from a peak and lost momentum take parts of larger ones.
LIFE_RULES = [Rule("silent", 1.0, "v < 25 AND dry >= 4"), Rule("drained", 0.5, "v < 25 AND flow < -0.55 AND roc_12 < -0.4"), Rule("slump", 0.5, "v >= 25 AND v < 110 AND off_peak < -0.6 AND holders <= 0.02"), Rule("cool", 0.125, "v >= 25 AND v < 110 AND gain > 0.25 AND roc_4 < -0.2"),
              Rule("below_mean", 0.25, "v >= 25 AND v < 110 AND gap < -0.45 AND roc_12 < -0.3"), Rule("leaving", 0.25, "v >= 110 AND joining < -0.05 AND flow < 0"),
              Rule("peak_gone", 0.25, "v >= 110 AND best > 1.5 AND off_peak < -0.2"), Rule("quiet_top", 0.125, "v >= 110 AND dry >= 2")]
STEPS = [(0.25, 0.125), (1.0, 0.25), (4.0, 0.25), (-0.2, 0.25), (-0.6, 1.0)]
STEP_PART = " + ".join(f"CASE WHEN gain >= {g} AND coalesce(hi < {g}, true) THEN {p} ELSE 0 END" if g > 0 else f"CASE WHEN gain <= {g} AND coalesce(lo > {g}, true) THEN {p} ELSE 0 END" for g, p in STEPS)


@query(f"""SELECT a.k, a.ret AS lifecycle, a.n_sales, b.ret AS ladder, c.hold FROM (WITH {sales_sql(LIFE_ROWS, cases(LIFE_RULES, 'part'))} {OUTCOME}) a JOIN (WITH {sales_sql(LIFE_ROWS, STEP_PART)} {OUTCOME}) b ON b.k = a.k
JOIN (WITH {BARS_U} SELECT k, last(v ORDER BY ts, id) * 0.97 / (first(v ORDER BY ts, id) * 1.03) - 1 AS hold FROM bars_u GROUP BY k) c ON c.k = a.k""", "lifecycle ladder hold")
def h21_lifecycle(spark, d):
    """Rules by band of the value, a ladder of gains and losses, and buy-and-hold of each user's series."""
    s = X.life_signals(bars_u(spark, d), U, "v", "vol", "h").withColumns({"roc_4": U.roc("v", 4, head=0.0), "dry": F.col("dry_rows"), "holders": F.col("holder_trend"), "roc_12": U.roc("v", 12, head=0.0), "joining": F.col("holder_accel"), "flow": F.col("volume_trend"), "gap": F.col("vwap_gap")})
    p = Q.position(s.select("k", "i", *O, "v", "roc_4", "dry", "holders", "roc_12", "joining", "flow", "gap"), "k", ["i"], "v")
    life = Q.managed(p, "k", ["i"], LIFE_RULES).select("k", F.col("ret").alias("lifecycle"), "n_sales")
    lad = Q.outcome(Q.sell(p, "k", ["i"], Q.ladder_part("k", ["i"], "gain", STEPS)), "k", ["i"]).select("k", F.col("ret").alias("ladder"))
    return life.join(lad, "k").join(K.partial_returns(s, "k", O, ["v"], lambda a: R.buy_and_hold(a["v"], 3.0)).select("k", F.col("ret").alias("hold")), "k")


@query(f"WITH {BARS_U} SELECT k, last(v ORDER BY ts, id) * 0.97 / (first(v ORDER BY ts, id) * 1.03) - 1 AS ret FROM bars_u GROUP BY k", "ret")
def h21_buy_and_hold(spark, d):
    return K.partial_returns(bars_u(spark, d), "k", O, ["v"], lambda a: R.buy_and_hold(a["v"], 3.0)).select("k", "ret")


SIGNAL_ROWS = f"""{BARS_U}, w AS (SELECT k, i, v, (v / nullif(avg(v) OVER (PARTITION BY k ORDER BY i ROWS 11 PRECEDING), 0) - 1) / 5 AS sig FROM bars_u), x AS (SELECT k, i, v, sig, lag(sig) OVER w AS was, coalesce(sig < -0.04 AND lag(sig) OVER w < -0.04 AND lag(sig, 2) OVER w < -0.04, false) AS lasting FROM w {W})"""
#: The first table reacts to single signals, the second by band of the value to signals that last three rows.
QUICK = [Rule("collapse", 1.0, "i >= 8 AND sig < -0.15"), Rule("weak_loss", 0.5, "i >= 8 AND gain < -0.25 AND sig < -0.05"), Rule("turn", 0.125, "i >= 8 AND gain > 0.4 AND was > 0.06 AND sig < 0")]
PATIENT = [Rule("small_stop", 1.0, "v < 20 AND gain < -0.7 AND lasting"), Rule("lasting", 0.25, "v >= 20 AND v < 110 AND i >= 8 AND lasting"), Rule("secure", 0.125, "v >= 20 AND v < 110 AND i >= 8 AND gain > 1.5 AND sig < was / 3"),
           Rule("deep", 0.5, "v >= 110 AND i >= 8 AND lasting AND sig < -0.09"), Rule("top", 0.25, "v >= 110 AND i >= 8 AND lasting"), Rule("top_secure", 0.125, "v >= 110 AND i >= 8 AND gain > 2 AND sig < was / 4")]


@query(f"SELECT a.k, a.ret AS v1, a.n_sales, b.ret AS v2 FROM (WITH {sales_sql(SIGNAL_ROWS, cases(QUICK, 'part'))} {OUTCOME}) AS a JOIN (WITH {sales_sql(SIGNAL_ROWS, cases(PATIENT, 'part'))} {OUTCOME}) AS b ON b.k = a.k", "v1 v2")
def h22_signal_manager(spark, d):
    """Positions managed by a predicted return, under two rule tables."""
    b = bars_u(spark, d).withColumn("sig", U.ma_deviation("v", 12) / 5)
    low = lambda n: (F.col("sig") if not n else U.lag("sig", n)) < -0.04
    p = Q.position(b.withColumns({"was": U.lag("sig"), "lasting": F.coalesce(low(0) & low(1) & low(2), F.lit(False))}), "k", ["i"], "v")
    one = Q.managed(p, "k", ["i"], QUICK).select("k", F.col("ret").alias("v1"), "n_sales")
    return one.join(Q.managed(p, "k", ["i"], PATIENT).select("k", F.col("ret").alias("v2")), "k")


def entries(spark, d):
    """Rows after each entry at a large value, with hindsight columns, keyed by entry_id."""
    b = bars_u(spark, d).select("k", "i", "v")
    t = J.entry_ticks(b.where("v >= 60").select("k", F.col("i").alias("entry_idx")), b, "k", "entry_idx", "i", 24).withColumn("entry_id", F.concat_ws(":", "k", "entry_idx"))
    e = Series("entry_id", "tick")
    return t.withColumns({"peak": F.coalesce(e.is_local_peak("v", 3), F.lit(False)), "best": e.future_extreme("v", None), "near_low": e.future_extreme("v", 6, "min")})


ENTRY_ROWS = f"""{BARS_U}, t AS (SELECT e.k || ':' || e.i AS entry_id, b.i - e.i AS tick, b.v FROM bars_u AS e JOIN bars_u AS b ON b.k = e.k AND b.i BETWEEN e.i AND e.i + 23 WHERE e.v >= 60),
y AS (SELECT *, count(*) OVER a - 1 - tick AS to_end, max(v) OVER f AS top, min(v) OVER (PARTITION BY entry_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS low, coalesce(count(v) OVER n3 = 3 AND v >= max(v) OVER n3, false) AS peak
FROM t WINDOW a AS (PARTITION BY entry_id), f AS (PARTITION BY entry_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n3 AS (PARTITION BY entry_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
x AS (SELECT entry_id, tick, v, to_end, peak, (top - v) / greatest(v, 1) AS upside, (low - v) / greatest(v, 1) AS dip FROM y)"""
#: Cuts of losses and sales at a large gain, whose size depends on the share that is left.
CUTS = [Rule("SL_50", 0.5, "gain < -0.2 AND upside < 0.05", ("EXIT", 1.0)), Rule("SL_25", 0.25, "gain < -0.15 AND upside < 0.03 AND dip < -0.05")]
AT_PEAK = Rule("TP_50", 0.5, "peak AND gain > 1.5 AND upside < 0.2", ("TP_100", 1.0))
#: With the future known (upside: to the best later value, dip: to the lowest of the next rows): what would have been right.
BY_WINDOW = [Rule("TP_100", 1.0, "to_end <= 1 AND gain > 0.1"), Rule("EXIT", 1.0, "to_end <= 1"), Rule("EXIT", 1.0, "gain < -0.3 AND upside < 0.1"), *CUTS, AT_PEAK, Rule("TP_50", 0.5, "peak AND gain > 0.5 AND dip < -0.2", ("TP_25", 0.25)),
             Rule("TP_25", 0.25, "peak AND gain > 0.2 AND dip < -0.15")]
BY_TICK = [Rule("HOLD", 0.0, "to_end = 0"), Rule("EXIT", 1.0, "gain < -0.35"), AT_PEAK, Rule("TP_50", 0.5, "peak AND gain > 0.8 AND dip < -0.15", ("TP_25", 0.25)), Rule("TP_25", 0.25, "peak AND gain > 0.3 AND dip < -0.15"),
           Rule("TP_50", 0.5, "gain > 1 AND dip < -0.25", ("TP_100", 1.0)), Rule("TP_25", 0.25, "gain > 0.5 AND dip < -0.3 AND upside < 0.3"), Rule("EXIT", 1.0, "gain < -0.25 AND upside < 0.1"), *CUTS]


def actions_sql(rules: list[Rule]) -> str:
    """Recursive SQL of hindsight rules that depend on the share left: ``s`` has for each row after an entry its gain, action and the share before and after it."""
    held = lambda of: "CASE WHEN share <= 0.01 THEN " + of(("HOLD", 0.0)) + " " + " ".join(f"WHEN {r.when} THEN " + (f"CASE WHEN share > 0.5 THEN {of((r.action, r.part))} ELSE {of(r.late)} END" if r.late else of((r.action, r.part))) for r in rules) + f" ELSE {of(('HOLD', 0.0))} END"
    return f"""WITH RECURSIVE {ENTRY_ROWS}, g AS (SELECT *, (v - first(v) OVER w) / greatest(first(v) OVER w, 1) AS gain FROM x WINDOW w AS (PARTITION BY entry_id ORDER BY tick)),
s(entry_id, tick, gain, action, before, after) AS (SELECT entry_id, -1::BIGINT, 0::DOUBLE, '', 1::DOUBLE, 1::DOUBLE FROM g WHERE tick = 0 UNION ALL
SELECT entry_id, tick, gain, action, before, before - least(before, part) FROM (SELECT *, CASE WHEN share > 0.01 THEN share ELSE 0 END AS before, {held(lambda c: f"'{c[0]}'")} AS action, {held(lambda c: f"{c[1]!r}::DOUBLE")} AS part
FROM (SELECT g.*, s.after AS share FROM s JOIN g ON g.entry_id = s.entry_id AND g.tick = s.tick + 1)))"""


ACTIONS = "SELECT entry_id, CAST(tick AS INT) AS tick, action, before, after FROM s WHERE tick >= 0"


def actions(spark, d, rules: list[Rule]):
    """Hindsight actions of each row after an entry, under rules that depend on the share left, with the shares before and after."""
    base = F.greatest("v", F.lit(1.0))
    t = entries(spark, d).withColumns({"to_end": F.count("*").over(Window.partitionBy("entry_id")) - 1 - F.col("tick"), "upside": (F.col("best") - F.col("v")) / base, "dip": (F.col("near_low") - F.col("v")) / base}).drop("best")
    return Q.sell_by_share(Q.position(t, "entry_id", ["tick"], "v"), "entry_id", ["tick"], rules, "gain")


@query(f"{actions_sql(BY_TICK)} {ACTIONS}", "before after")
def h23_tick_actions(spark, d):
    """The second rule set: a hard stop, and profits taken off the peak too; nothing is closed at the end."""
    return actions(spark, d, BY_TICK).select("entry_id", F.col("tick").cast("int").alias("tick"), "action", "before", "after")


@query(f"{actions_sql(BY_WINDOW)} {ACTIONS}", "before after")
def h23_label_actions(spark, d):
    """The first rule set: also empties the position on its last two rows."""
    return actions(spark, d, BY_WINDOW).select("entry_id", F.col("tick").cast("int").alias("tick"), "action", "before", "after")


@query(f"""WITH RECURSIVE {BARS_U}, w AS (SELECT k, i, v, coalesce(v / nullif(lag(v, 4) OVER w, 0) - 1 >= 0.2, false) AND least(vol / 100, 1) >= 0.5 AS cand, CASE WHEN v / nullif(max(v) OVER w, 0) - 1 < -0.5 THEN 'SL_25' ELSE 'HOLD' END AS act FROM bars_u {W}),
f(k, i, hit, free) AS (SELECT k, i, cand, CASE WHEN cand THEN i + 12 ELSE 0 END FROM w WHERE i = 0 UNION ALL SELECT w.k, w.i, w.cand AND w.i >= f.free, CASE WHEN w.cand AND w.i >= f.free THEN w.i + 12 ELSE f.free END FROM f JOIN w ON w.k = f.k AND w.i = f.i + 1),
x AS (SELECT f.k, f.i AS e, w.i - f.i AS tick, w.v, first(w.v) OVER w AS p, lag(w.v) OVER w AS v1, max(w.i - f.i) OVER (PARTITION BY f.k, f.i) AS z, w.act FROM f JOIN w ON w.k = f.k AND w.i BETWEEN f.i AND f.i + 47 WHERE hit WINDOW w AS (PARTITION BY f.k, f.i ORDER BY w.i)),
s(k, e, tick, rest, made, peak, held) AS (SELECT k, e, -1::BIGINT, 1::DOUBLE, 0::DOUBLE, v, NULL::BIGINT FROM x WHERE tick = 0 UNION ALL
SELECT k, e, tick, rest - cut, made + cut * gain * CASE WHEN rug THEN 1 ELSE 0.97 END, peak, CASE WHEN rug THEN tick WHEN rest - cut <= 0.01 THEN tick + 1 END FROM (SELECT *, CASE WHEN rug THEN rest ELSE least(rest, CASE WHEN gain < -0.35 THEN 1 WHEN act = 'SL_25' OR gain > 1 AND rest > 0.25 THEN 0.25 ELSE 0 END) END AS cut FROM
(SELECT x.*, s.rest, s.made, greatest(s.peak, x.v) AS peak, (x.v - x.p) / greatest(x.p, 1) AS gain, coalesce((x.v - x.v1) / greatest(x.v1, 1) < -0.5, false) AS rug FROM s JOIN x ON x.k = s.k AND x.e = s.e AND x.tick = s.tick + 1 WHERE s.held IS NULL)))
SELECT s.k, CAST(s.e AS INT) AS entry_idx, made + CASE WHEN rest > 0.01 THEN rest * (v - p) / greatest(p, 1) * 0.97 ELSE 0 END AS ret, CAST(coalesce(held, x.z + 1) AS INT) AS held, (peak - p) / greatest(p, 1) AS best FROM s JOIN x ON x.k = s.k AND x.e = s.e AND x.tick = s.tick WHERE held IS NOT NULL OR s.tick = x.z""", "ret best")
def h24_funnel(spark, d):
    b = bars_u(spark, d).withColumns({"cand": F.coalesce(U.roc("v", 4) >= 0.2, F.lit(False)), "score": F.least(F.col("vol") / 100, F.lit(1.0)), "act": F.when(U.drawdown("v") < -0.5, "SL_25").otherwise("HOLD")})
    return K.simulate_funnel(b, "k", O, "v", "cand", "score", "act", 0.5)


@query(f"""{actions_sql(BY_WINDOW)} SELECT entry_id, sum((before - after) * gain) AS ret, CAST(min(tick) FILTER (after <= 0.01) + 1 AS INT) AS held, last(gain ORDER BY tick) AS hold_ret, coalesce(first(gain ORDER BY tick) FILTER (gain >= 1 OR gain <= -0.2), last(gain ORDER BY tick)) AS rules_ret
FROM s WHERE tick >= 0 GROUP BY entry_id""", "ret hold_ret rules_ret")
def h25_replay_actions(spark, d):
    """Return of each entry under its actions, against holding to the end and against a fixed target and stop."""
    t = actions(spark, d, BY_WINDOW)
    fixed = F.min_by("gain", F.when((F.col("gain") >= 1) | (F.col("gain") <= -0.2), F.col("tick")))
    other = t.groupBy("entry_id").agg(F.max_by("gain", "tick").alias("hold_ret"), F.coalesce(fixed, F.max_by("gain", "tick")).alias("rules_ret"))
    return Q.outcome(t, "entry_id", ["tick"], 0.0).drop("n_sales").join(other, "entry_id")


@query(f"""SELECT cfg, split, {STATS} FROM (SELECT split_part(k, '|', 1) AS cfg, CASE WHEN {SPLIT.replace('c_custkey', "split_part(k, '|', 2)")} < 60 THEN 'train' ELSE 'test' END AS split, return_pct, bars_held FROM
({position_sql(BAR_ROWS + ", c AS (SELECT unnest([10.0, 20.0, 40.0]) AS stop), x AS (SELECT y.* REPLACE ('stop' || c.stop || '_roc' || r.least_roc || '|' || k AS k), stop, stop / 2 AS tight, least_roc, ok AND coalesce(roc > least_roc AND rvol > 1.2, false) AS en FROM y, c, (SELECT unnest([1.0, 3.0]) AS least_roc) AS r)", BAR_RULES)} {TRADE_SQL} UNION ALL {OPEN_AT_END})) GROUP BY ALL""", STAT_FLOATS)
def jn16_sweep(spark, d):
    """Workload W2: the indicator strategy over a grid, statistics by configuration and split (bars are moved once)."""
    grid = {f"stop{s}_roc{r}": R.BarConfig(stop=s, tight=s / 2, roc=r) for s in (10.0, 20.0, 40.0) for r in (1.0, 3.0)}
    t = K.sweep(bar_inputs(spark, d), "k", ["ts"], BAR_COLS, grid, run_bars)
    return A.trade_stats(t.withColumn("split", hash_split("k")), ["cfg", "split"])


