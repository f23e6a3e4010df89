"""Scalar expressions. All of them are built-in Spark functions, so they stay inside generated code.

Missing values are NULL: NaN and infinities are turned into NULL or a fill value where they can come up,
because Spark sorts NaN above every number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- casts and time ---------------------------------------------------------------------------------


def safe_float(c: ColumnLike, default: float | None = None) -> Column:
    """Number from text or number; ``default`` where it does not parse or is NaN or infinite."""
    x = col(c).try_cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def to_ts(c: ColumnLike) -> Column:
    """Timestamp from epoch seconds or milliseconds (numbers above 1e12 are milliseconds)."""
    x = safe_float(c)
    return F.timestamp_micros(F.round(F.when(x > 1e12, x * 1000).otherwise(x * 1e6)).cast("bigint"))


def parse_iso(c: ColumnLike) -> Column:
    """Timestamp from ISO-8601 text (session time zone where the text has none); NULL if it is none."""
    return F.try_to_timestamp(col(c))


def epoch(ts: ColumnLike) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(col(ts).cast("timestamp")) / 1e6


def floor_ts(ts: ColumnLike, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    return F.timestamp_seconds(F.floor(epoch(ts) / seconds) * seconds)


def week_windows(end: ColumnLike, n: int) -> Column:
    """Array of the ``n`` Monday-aligned weeks up to and with that of ``end``: structs of (start, stop)."""
    last = F.date_trunc("week", col(end))
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.struct((last - F.make_dt_interval(i * 7)).alias("start"), (last - F.make_dt_interval((i - 1) * 7)).alias("stop")))


# --- guards -----------------------------------------------------------------------------------------


def sanitize(c: ColumnLike, fill: float | None = 0.0) -> Column:
    x = col(c)
    clean = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    return clean if fill is None else F.coalesce(clean, F.lit(fill))


def clip(c: ColumnLike, low: float, high: float) -> Column:
    """NULL stays NULL (least and greatest alone would take the bound)."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0))


def guarded(a: ColumnLike, b: ColumnLike) -> Column:
    """a / max(b, 1)."""
    return col(a) / F.greatest(col(b), F.lit(1.0))


def correlation(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: Pearson correlation of the rows that have both, NULL where either is constant."""
    a, b = (F.when(col(x).isNotNull() & col(y).isNotNull(), col(c)) for c in (x, y))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


# --- maths ------------------------------------------------------------------------------------------


def signed_log1p(c: ColumnLike) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def neg_log1p(c: ColumnLike) -> Column:
    """-log1p(max(-x, 0))."""
    return -F.log1p(F.greatest(-col(c), F.lit(0.0)))


def ramp(c: ColumnLike, low: float, high: float) -> Column:
    """Linear from 0 at ``low`` to 1 at ``high``, constant outside."""
    return clip((col(c) - low) / (high - low), 0.0, 1.0)


def ladder(c: ColumnLike, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y) points with rising x; constant outside."""
    x = col(c)
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x > points[-1][0], F.lit(float(points[-1][1])))


def freshness(hours: ColumnLike, full: float = 2.0, half: float = 12.0, none: float = 48.0) -> Column:
    """1 up to ``full`` hours of age, 0.5 at ``half``, 0 from ``none`` on."""
    return ladder(hours, [(full, 1.0), (half, 0.5), (none, 0.0)])


def health(current: ColumnLike, peak: ColumnLike, change: ColumnLike, deep: float = 0.8, crash: float = -0.5) -> Column:
    """Share of the peak that is left (0 at a drawdown of ``deep``), halved again by a recent crash."""
    kept = ramp(ratio(current, peak), 1 - deep, 1.0)
    return kept * F.when(col(change) <= crash, F.lit(0.5)).otherwise(1.0)


def blend(p1: ColumnLike, p2: ColumnLike, w: float = 0.5) -> Column:
    """Mean of two multiples in log space: expm1(w * log1p(p1) + (1 - w) * log1p(p2))."""
    return F.expm1(w * F.log1p(col(p1)) + (1 - w) * F.log1p(col(p2)))


def weighted(parts: dict[str, float], digits: int = 4) -> Column:
    """Rounded weighted sum of columns; missing parts count as 0."""
    return F.round(reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items())), digits)


def slipped(price: ColumnLike, percent: float, side: str) -> Column:
    """Fill price after slippage: buys pay more, sells get less."""
    return col(price) * (1 + percent / 100 if side == "buy" else 1 - percent / 100)


def pnl(entry: ColumnLike, exit: ColumnLike, size: ColumnLike) -> Column:
    """Struct of (percent, amount) of a position of ``size`` money."""
    move = col(exit) / F.nullif(col(entry), F.lit(0)) - 1
    return F.struct((move * 100).alias("percent"), (move * col(size)).alias("amount"))


# --- labels and text --------------------------------------------------------------------------------


def bucket(c: ColumnLike, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open interval [edge, next edge) that holds the value; NULL stays NULL."""
    out = F.when(col(c) < edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(col(c) < edge, F.lit(label))
    return out.when(col(c) >= edges[-1], F.lit(labels[len(edges)]))


def first_reason(rules: list[tuple[str, Column]], ok: str | None = None) -> Column:
    """Name of the first rule that holds, in order; ``ok`` if none does."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, cond in rules[1:]:
        out = out.when(cond, F.lit(name))
    return out.otherwise(F.lit(ok))


def tags(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def join_reasons(rules: list[tuple[str, Column]], sep: str = "; ") -> Column:
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in rules])


def clip_text(c: ColumnLike, n: int) -> Column:
    return F.substring(col(c), 1, n)


def detect_chain(c: ColumnLike) -> Column:
    """Chain from the form of a key: 0x and 42 characters is an EVM address, 32 to 44 others a base-58 one."""
    x = col(c)
    return F.when(F.lower(x).startswith("0x") & (F.length(x) == 42), "evm").when((F.length(x) >= 32) & (F.length(x) <= 44), "base58").otherwise("unknown")


def sell_fraction(action: ColumnLike, fractions: dict[str, float]) -> Column:
    """Fraction of the remaining position that an action sells; unknown actions sell nothing."""
    table = F.create_map(*[F.lit(x) for pair in fractions.items() for x in pair])
    return F.coalesce(table[col(action)], F.lit(0.0))


def grade(c: ColumnLike, thresholds: list[tuple[float, str]], rest: str = "D") -> Column:
    """Grade of the first (highest) threshold reached."""
    out = F.when(col(c) >= thresholds[0][0], F.lit(thresholds[0][1]))
    for at, name in thresholds[1:]:
        out = out.when(col(c) >= at, F.lit(name))
    return out.otherwise(F.lit(rest))


def forward_label(multiple: ColumnLike, low_ratio: ColumnLike, up: float, down: float) -> Column:
    """pump if the best future multiple reaches ``up`` (tested first), dump if the worst falls to ``down``, else flat."""
    return F.when(col(multiple) >= up, "pump").when(col(low_ratio) <= down, "dump").otherwise("flat")


# --- maps, arrays, hashes ---------------------------------------------------------------------------


def map_sum(m: ColumnLike, *keys: str) -> Column:
    """Sum of map entries; missing maps and keys count as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.try_element_at(col(m), F.lit(k)), F.lit(0)) for k in keys))


def l2_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def norm(a: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def hash_bucket(c: ColumnLike, n: int = 100) -> Column:
    """The key's 128-bit md5 as an integer, modulo ``n``: folded over four 32-bit chunks."""
    digest = F.md5(col(c).cast("string"))
    out = F.lit(0).cast("bigint")
    for i in range(4):
        chunk = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        out = F.pmod(out * F.lit(16**8 % n) + chunk, F.lit(n))
    return out


def hash_split(c: ColumnLike, train: float = 0.6) -> Column:
    """train for the keys with an md5 bucket below 100 * train, else test."""
    return F.when(hash_bucket(c) < int(round(train * 100)), "train").otherwise("test")
