"""Recurrences of a key's series in segments, so that no task holds a whole key.

A series is cut into segments of time of about ``rows`` rows. Each segment is reduced, by itself, to the map from the state
before it to the state after it; the maps of a key (a few numbers for thousands of rows) are applied one after the other,
which gives the state that each segment starts from; then the segments are replayed from these states, all in parallel. What
a map is depends on the recurrence: a matrix and a vector for linear filters, a clamped line where values are cut to a
range, pieces of clamped shifts with returns to 0 for cumulative sums. Steps that need another recurrence's
output come in a later round. A segment also gets the last rows before it and its place in the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import dsp, paths
from .stats import written_once

ROWS = 8192
Arrays = dict[str, np.ndarray]


class Segment:
    """Rows of a segment (``x``, by column), the last rows before it (``halo``), its first row's place (``base``) and the states before it (``state``)."""

    def __init__(self, x: Arrays, halo: Arrays, base: int, state: dict[str, np.ndarray]):
        self.x, self.halo, self.base, self.state = x, halo, base, state
        self.memo: dict[str, object] = {}  # what steps share

    def padded(self, col: str, n: int) -> np.ndarray:
        """The column with ``n`` values before it (0 where the series has none)."""
        before = self.halo[col][-n:] if n else self.halo[col][:0]
        return np.concatenate([np.zeros(n - len(before)), before, self.x[col]])


class Step:
    """One recurrence: ``reduce`` gives a segment's map as numbers, ``apply`` the state after it (before it, if the recurrence runs ``back``)."""

    name, back = "", False
    start: Sequence[float] = ()

    def reduce(self, s: Segment) -> Sequence[float]:
        raise NotImplementedError

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        raise NotImplementedError


# --- segments ---------------------------------------------------------------------------------------


def packed(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], rows: int = ROWS) -> DataFrame:
    """(by, seg, n, rows): one row for each segment, its rows as a sorted array. A key's time from first to last row is cut into equal parts,
    one for about every ``rows`` rows; rows of one time stay together."""
    t = F.unix_micros(order[0]) if isinstance(df.schema[order[0]].dataType, T.TimestampType) else F.col(order[0]).cast("long")
    df = df.select(*dict.fromkeys([by, *order, *cols])).withColumn("_t", t)
    keys = df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_parts"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    place = F.least(F.col("_parts") - 1, F.floor((F.col("_t") - F.col("_first")) / (F.col("_last") - F.col("_first") + 1.0) * F.col("_parts"))).cast("long")
    dealt = df.join(keys, F.col(by).eqNullSafe(F.col("_by"))).select(by, F.coalesce(place, F.lit(0)).alias("seg"), F.struct(*dict.fromkeys([*order, *cols])).alias("r"))
    return dealt.groupBy(by, "seg").agg(F.sort_array(F.collect_list("r")).alias("rows")).withColumn("n", F.size("rows"))  # about ``rows`` rows


def _heads(p: DataFrame, by: str, halo: int) -> DataFrame:
    """(_key, _seg, base, halo): rows before each segment, and the last ``halo`` of them."""
    w = Window.partitionBy("_key").orderBy("_seg")
    tails = p.select(F.col(by).alias("_key"), F.col("seg").alias("_seg"), "n", F.slice("rows", F.greatest(F.lit(1), F.col("n") - max(halo, 1) + 1), max(halo, 1)).alias("tail"))
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-max(halo, 1), -1)))
    out = tails.select("_key", "_seg", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), before.alias("b"))
    return out.select("_key", "_seg", "base", F.slice("b", F.greatest(F.lit(1), F.size("b") - halo + 1), halo).alias("halo"))


def _fields(struct: pa.StructArray, cols: Sequence[str]) -> Arrays:
    return {c: struct.field(c).to_numpy(zero_copy_only=False) for c in cols}


def _segments(batch: pa.RecordBatch, cols: Sequence[str], names: Sequence[str]) -> Iterator[tuple[int, Segment]]:
    rows, halo, base = (batch.column(batch.schema.get_field_index(c)) for c in ("rows", "halo", "base"))
    states = {n: batch.column(batch.schema.get_field_index(f"_{n}")).to_pylist() for n in names}
    for i in range(batch.num_rows):
        yield i, Segment(_fields(rows[i].values, cols), _fields(halo[i].values, cols), base[i].as_py(), {n: np.array(x[i], float) for n, x in states.items()})


def _folded(steps: Sequence[Step]) -> Callable[[pa.Table], pa.Table]:
    """The maps of a key's segments applied one after the other: the states before each segment."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("_seg")
        columns = []
        for step in steps:
            state, before = np.array(step.start, float), []
            maps = table[step.name].to_pylist()
            for found in reversed(maps) if step.back else maps:
                before.append(state.tolist())
                state = np.array(step.apply(state, np.array(found)), float)
            before = before[::-1] if step.back else before
            columns.append(pa.array(before, pa.list_(pa.float64())))
        return pa.table([table["_key"], table["_seg"], *columns], names=table.column_names)

    return fold


def scan(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], rounds: Sequence[Sequence[Step]], replay: Callable[[Segment], Arrays], schema: str, halo: int = 0, rows: int = ROWS, ready: bool = False) -> DataFrame:
    """``replay`` on every segment with the states of all steps before it; its arrays come back under ``by`` and ``schema``. Rows pass one exchange when they are
    packed and, as whole segments, one for each join with the states unless these are small enough for Spark to broadcast. ``ready``: ``df`` is a result of ``packed``."""
    p = df if ready else written_once(packed(df, by, order, cols, rows))
    heads, known = written_once(_heads(p, by, halo)), []
    key = df.schema[by].dataType
    kind = T.StructType([T.StructField("_key", key), T.StructField("_seg", T.LongType())])

    def met() -> DataFrame:
        return p.join(heads, F.col(by).eqNullSafe(F.col("_key")) & (F.col("seg") == F.col("_seg")))

    for steps in rounds:
        names, earlier = [s.name for s in steps], list(known)
        found = T.StructType([*kind.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])

        def reduce(batches: Iterator[pa.RecordBatch], steps=steps, earlier=earlier) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maps = [[[float(v) for v in s.reduce(x)] for s in steps] for _, x in _segments(batch, cols, earlier)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([m[j] for m in maps], pa.list_(pa.float64())) for j in range(len(steps))]], names=["_key", "_seg", *[s.name for s in steps]])

        states = met().select("_key", "_seg", "rows", "halo", "base", *[f"_{n}" for n in earlier]).mapInArrow(reduce, found).groupBy("_key").applyInArrow(_folded(steps), found)
        states = states.select(F.col("_key").alias("_key2"), F.col("_seg").alias("_seg2"), *[F.col(n).alias(f"_{n}") for n in names])
        heads = written_once(heads.join(states, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_seg") == F.col("_seg2"))).drop("_key2", "_seg2"))
        known += names

    out = T.StructType([T.StructField(by, key), *T._parse_datatype_string(f"struct<{schema}>").fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _segments(batch, cols, known):
                got = replay(x)
                n = len(got[out.names[1]])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), *[pa.array(got[c]).cast(t) for c, t in zip(out.names[1:], kinds)]], names=out.names)

    return met().select("_key", "_seg", "rows", "halo", "base", *[f"_{n}" for n in known]).mapInArrow(run, out)


# --- linear recurrences -----------------------------------------------------------------------------


def recur(gain: np.ndarray, b1: float, b2: float, y1: float, y2: float, fixed: np.ndarray) -> np.ndarray:
    """y[i] = gain[i] + b1 * y[i - 1] + b2 * y[i - 2] behind ``fixed``, the values of the first rows."""
    y = np.empty(len(gain))
    for i in range(len(gain)):
        y[i] = fixed[i] if i < len(fixed) else gain[i] + b1 * y1 + b2 * y2
        y1, y2 = y[i], y1
    return y


class Filters(Step):
    """Roofing filters and the instantaneous trend line. The state holds the last two outputs of every stage; on the first two rows of a
    series the outputs are 0 and the trend is the input. (Inputs before a segment are read, not carried, so a constant series gives zeros.)"""

    name, bands, trend = "filters", ((48, 10), (40, 10)), 10
    start = (0.0,) * 10

    def run(self, ext: np.ndarray, state: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The outputs (a roofing filter for each band, the trend line) over inputs with the two before them, and the state after; linear in both."""
        head, outs, after = min(len(ext) - 2, max(0, 2 - base)), [], []
        for (high, low), at in zip(self.bands, (0, 4)):
            k, (b1, b2) = dsp.high_pass_weight(high), dsp.smoother_weights(low)
            hp = recur(((1 + k) / 2) ** 2 * (ext[2:] - 2 * ext[1:-1] + ext[:-2]), 2 * k, -k * k, state[at], state[at + 1], np.zeros(head))
            flat = np.concatenate([state[at : at + 1], hp])
            y = recur((1 - b1 - b2) * (flat[1:] + flat[:-1]) / 2, b1, b2, state[at + 2], state[at + 3], np.zeros(head))
            outs.append(y)
            after += [*_last(hp, state[at : at + 2]), *_last(y, state[at + 2 : at + 4])]
        b1, b2 = dsp.smoother_weights(self.trend)
        t = recur((1 - b1 - b2) * (ext[2:] + ext[1:-1]) / 2, b1, b2, state[8], state[9], ext[2 : 2 + head])
        return [*outs, t], np.array([*after, *_last(t, state[8:10])])

    def reduce(self, s: Segment) -> Sequence[float]:
        n = len(s.x["v"])
        return [n, min(n, max(0, 2 - s.base)), *self.run(s.padded("v", 2), np.zeros(10), s.base)[1]]

    @lru_cache(maxsize=1024)  # noqa: B019  one object a process
    def power(self, n: int, head: int) -> np.ndarray:
        """What becomes of a state over n rows of which ``head`` are among the first two of the series."""
        one = lambda base: np.stack([self.run(np.zeros(3), e, base)[1] for e in np.eye(10)], axis=1)
        return np.linalg.matrix_power(one(2), n - head) @ np.linalg.matrix_power(one(0), head)

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        return self.power(int(found[0]), int(found[1])) @ state + found[2:]


def _last(y: np.ndarray, before: np.ndarray) -> list[float]:
    """The last two outputs, the latest first."""
    both = np.concatenate([before[::-1], y])
    return [both[-1], both[-2]]


class Averages(Step):
    """Exponential averages of the values that are not NaN, held in between, and the average of the difference of two of them (MACD). State: how many values
    there were (0: the next one starts the averages) and the four averages."""

    name, spans = "averages", (6, 13, 13)
    start = (0.0,) * 5

    def run(self, v: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        """The averages after each row; NaN before the first value of the series."""
        out, some, count = [], ~np.isnan(v), state[0]
        at = np.cumsum(some)
        for span, y in zip(self.spans, state[1:4]):
            a = 2.0 / (span + 1)
            own = recur(a * v[some], 1 - a, 0.0, y, 0.0, v[:0] if count else v[some][:1])
            out.append(np.concatenate([[y if count else np.nan], own])[at])
        line, a = out[0] - out[1], 2.0 / 6
        known = line[0 if count else len(v) - int((at > 0).sum()) :]
        last = recur(a * known, 1 - a, 0.0, state[4], 0.0, known[: 0 if count else 1])
        return [*out, np.concatenate([np.full(len(v) - len(known), np.nan), last])]

    def reduce(self, s: Segment) -> Sequence[float]:
        v = s.x["v"]
        ends = lambda v, state: np.array([y[-1] for y in self.run(v, state)])
        known = lambda e: np.concatenate([[1.0], e])
        gone = np.where(np.isnan(v), np.nan, 0.0)
        if np.isnan(gone).any():
            matrix = np.stack([ends(gone, known(e)) for e in np.eye(4)], axis=1)
        else:
            matrix = np.linalg.matrix_power(np.stack([ends(gone[:1], known(e)) for e in np.eye(4)], axis=1), len(v))
        return [(~np.isnan(v)).sum(), *ends(v, np.zeros(5)), *ends(v, known(np.zeros(4))), *matrix.ravel()]

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        if state[0]:
            return [state[0] + found[0], *(found[9:].reshape(4, 4) @ state[1:] + found[5:9])]
        return [found[0], *found[1:5]] if found[0] else state

    def replay(self, s: Segment) -> Arrays:
        state = s.state[self.name]
        fast, slow, ema, line = self.run(s.x["v"], state)
        hist = fast - slow - line
        first = hist[:1] if not s.base else [state[1] - state[2] - state[4] if state[0] else np.nan]
        return {"ema_13": ema, "macd": fast - slow, "macd_signal": line, "macd_hist": hist, "macd_slope": np.diff(hist, prepend=first)}


class Decay(Step):
    """y = gain + rate * y over the output of an earlier step, from 0."""

    start = (0.0,)

    def __init__(self, name: str, rate: float, gain: Callable[[Segment], np.ndarray]):
        self.name, self.rate, self.gain = name, rate, gain

    def run(self, s: Segment, y: float) -> np.ndarray:
        return recur(self.gain(s), self.rate, 0.0, y, 0.0, np.zeros(0))

    def reduce(self, s: Segment) -> Sequence[float]:
        return [len(s.x["v"]), self.run(s, 0.0)[-1]]

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        return self.rate ** found[0] * state + found[1:]


# --- clamped lines, held values ---------------------------------------------------------------------


class Place(Step):
    """The Fisher transform's smoothed place in the last ``period`` values, cut to ±0.999. A segment is a clamped line
    x -> min(high, max(low, a * x + b)); such lines compose to one."""

    name, period, start = "place", 10, (0.0,)

    def places(self, s: Segment) -> np.ndarray:
        """The place of each row behind the first ``period`` of the series, unsmoothed."""
        v = s.padded("v", self.period - 1)
        w = np.lib.stride_tricks.sliding_window_view(v, self.period)
        low, span = w.min(axis=1), w.max(axis=1) - w.min(axis=1)
        own = np.divide(s.x["v"] - low, span, out=np.full(len(low), 0.5), where=span > 0)
        return (2 * (own - 0.5))[max(0, self.period - s.base) :]

    def reduce(self, s: Segment) -> Sequence[float]:
        a, b, low, high = 1.0, 0.0, -np.inf, np.inf
        cut = lambda x: min(0.999, max(-0.999, x))
        for p in (0.33 * self.places(s)).tolist():
            a, b, low, high = 0.67 * a, 0.67 * b + p, cut(0.67 * low + p), cut(0.67 * high + p)
        return [a, b, low, high]

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        a, b, low, high = found
        return [min(high, max(low, a * state[0] + b))]

    def run(self, s: Segment) -> np.ndarray:
        x, p = s.state[self.name][0], self.places(s)
        out = np.zeros(len(s.x["v"]))
        at = len(out) - len(p)
        for i, y in enumerate((0.33 * p).tolist()):
            x = out[at + i] = min(0.999, max(-0.999, y + 0.67 * x))
        return out


class Hurst(Step):
    """The Hurst exponent of the ``window`` values before every ``every``-th row, held in between; a segment hands on its last one."""

    name, window, every, start = "hurst", 48, 12, (0.5,)

    def found(self, s: Segment) -> list[tuple[int, float]]:
        v = s.padded("v", self.window)
        rows = [i for i in range(len(s.x["v"])) if s.base + i >= self.window and (s.base + i) % self.every == 0]
        return [(i, dsp.hurst(v[i : i + self.window])) for i in rows if v[i : i + self.window].std() > 0]

    def reduce(self, s: Segment) -> Sequence[float]:
        return [h for _, h in self.found(s)[-1:]]

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        return found if len(found) else state

    def run(self, s: Segment) -> np.ndarray:
        out, got = np.full(len(s.x["v"]), s.state[self.name][0]), self.found(s)
        for (i, h), end in zip(got, [*[i for i, _ in got[1:]], len(out)]):
            out[i:end] = h
        return out


# --- cumulative sums --------------------------------------------------------------------------------


class Sums(Step):
    """Sums that never fall below 0 and return to 0 above a limit. From a start u in [0, limit] a segment is a shift where u meets neither end, and a
    constant where it does: the map is a list of pieces (upper end, 1 for a shift or 0, value)."""

    start = (0.0,)

    def __init__(self, name: str, gains: Callable[[Segment], tuple[np.ndarray, float]]):
        self.name, self.gains = name, gains

    def reduce(self, s: Segment) -> Sequence[float]:
        gains, limit = self.gains(s)
        pieces = [(limit, 1, 0.0)]
        for c in gains.tolist():
            new, low = [], -np.inf
            for end, shift, value in pieces:
                value += c
                if shift:
                    cuts = [(min(end, -value), 0, 0.0), (min(end, limit - value), 1, value), (end, 0, 0.0)]
                else:
                    cuts = [(end, 0, 0.0 if value > limit else max(0.0, value))]
                for piece in cuts:
                    if piece[0] > low:
                        if new and not new[-1][1] and not piece[1] and new[-1][2] == piece[2]:
                            new.pop()
                        new.append(piece)
                        low = piece[0]
            pieces = new
        return [x for piece in pieces for x in piece]

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        pieces = found.reshape(-1, 3)
        _, shift, value = pieces[min(np.searchsorted(pieces[:, 0], state[0]), len(pieces) - 1)]
        return [state[0] * shift + value]

    def run(self, s: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Sums after each row, and where one returned to 0 from above the limit."""
        (gains, limit), x = self.gains(s), s.state[self.name][0]
        out, back = np.zeros(len(gains)), np.zeros(len(gains), bool)
        for i, c in enumerate(gains.tolist()):
            x = max(0.0, x + c)
            back[i] = x > limit
            x = out[i] = 0.0 if back[i] else x
        return out, back


# --- operators --------------------------------------------------------------------------------------

INDICATORS = "ema_13 double, macd double, macd_signal double, macd_hist double, macd_slope double, roofing double, fisher double, fisher_signal double, ebsw double, itrend double, itrend_trigger double, above_itrend int, hurst double"


def _wave(s: Segment) -> np.ndarray:
    """The gain of the sine wave: the filtered wave over the root of its two-row power."""
    f = FILTERS.run(s.padded("v", 2), s.state["filters"], s.base)[0][1]
    before = s.state["filters"][6]
    power = (f**2 + np.concatenate([[before], f[:-1]]) ** 2) / 2
    if not s.base:
        power[:1] = 0
    return 0.67 * np.clip(np.divide(f, np.sqrt(power), out=np.zeros(len(f)), where=power > 0), -1, 1)


FILTERS, AVERAGES, PLACE, HURST = Filters(), Averages(), Place(), Hurst()
WAVE, TURNS = Decay("wave", 0.33, _wave), Decay("turns", 0.5, lambda s: np.arctanh(PLACE.run(s)) / 2)


def indicators(df: DataFrame, by: str, order: Sequence[str], v: str, idx: str, rows: int = ROWS) -> DataFrame:
    """EMA-based and recursive indicators of every row, keyed by (by, idx), in segments of about ``rows`` rows."""

    def replay(s: Segment) -> Arrays:
        outs, _ = FILTERS.run(s.padded("v", 2), s.state["filters"], s.base)
        line = np.concatenate([s.state["filters"][[9, 8]], outs[2]])
        trigger = np.where(np.arange(s.base, s.base + len(outs[2])) < 2, outs[2], 2 * line[2:] - line[:-2])
        turns = TURNS.run(s, s.state["turns"][0])
        signal = np.concatenate([[np.nan if not s.base else s.state["turns"][0]], turns[:-1]])
        return {idx: s.x["i"].astype(np.int64), **AVERAGES.replay(s), "roofing": outs[0], "fisher": turns, "fisher_signal": signal, "ebsw": WAVE.run(s, s.state["wave"][0]), "itrend": outs[2], "itrend_trigger": trigger,
                "above_itrend": (s.x["v"] > outs[2]).astype(np.int32), "hurst": HURST.run(s)}

    named = df.select(by, *order, F.col(v).cast("double").alias("v"), F.col(idx).cast("long").alias("i"))
    out = scan(named, by, order, ["v", "i"], [[FILTERS, AVERAGES, PLACE, HURST], [WAVE, TURNS]], replay, f"{idx} bigint, {INDICATORS}", HURST.window, rows)
    return out.withColumn("fisher_signal", F.when(~F.isnan("fisher_signal"), F.col("fisher_signal")))


def cusum(df: DataFrame, by: str, order: Sequence[str], v: str, idx: str, h: float = 1.0, drift: float = 0.0, rows: int = ROWS) -> DataFrame:
    """Two-sided cumulative sums (up, down, alarm) of every row; limit and drift in population deviations of the key's whole series."""
    sigma = df.groupBy(F.col(by).alias("_k")).agg(F.stddev_pop(F.col(v).cast("double")).alias("sd"))
    named = df.select(by, *order, F.col(v).cast("double").alias("v"), F.col(idx).cast("long").alias("i")).join(sigma, F.col(by).eqNullSafe(F.col("_k"))).drop("_k")

    def gains(sign: float) -> Callable[[Segment], tuple[np.ndarray, float]]:
        def of(s: Segment) -> tuple[np.ndarray, float]:
            sd = float(s.x["sd"][0]) or 1.0
            return (sign * s.x["v"] - drift * sd)[0 if s.base else 1 :], h * sd  # the first row of a series is 0

        return of

    up, down = Sums("up", gains(1.0)), Sums("down", gains(-1.0))

    def replay(s: Segment) -> Arrays:
        (a, _), (b, alarm) = up.run(s), down.run(s)
        front = np.zeros(len(s.x["v"]) - len(a))
        return {idx: s.x["i"].astype(np.int64), "up": np.concatenate([front, a]), "down": -np.concatenate([front, b]), "alarm": np.concatenate([front > 0, alarm])}

    return scan(named, by, order, ["v", "i", "sd"], [[up, down]], replay, f"{idx} bigint, up double, down double, alarm boolean", 0, rows)


# --- path signatures --------------------------------------------------------------------------------


def _levels(s: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return s[..., :d], s[..., d : d + d * d].reshape(*s.shape[:-1], d, d), s[..., d + d * d :].reshape(*s.shape[:-1], d, d, d)


def chen(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Depth-3 signature of a path followed by another, for each row of ``b``: the product of the two in the truncated tensor algebra."""
    (a1, a2, a3), (b1, b2, b3) = _levels(a, d), _levels(b, d)
    one, two, three = a1 + b1, a2 + np.einsum("i,...j->...ij", a1, b1) + b2, a3 + np.einsum("ij,...k->...ijk", a2, b1) + np.einsum("i,...jk->...ijk", a1, b2) + b3
    flat = b.shape[:-1]
    return np.concatenate([one, two.reshape(*flat, -1), three.reshape(*flat, -1)], axis=-1)


class Signature(Step):
    """Signature of the path of some columns with time (a row is 1) as first dimension; the map of a segment is its own signature, from the row before it on."""

    name = "signature"

    def __init__(self, cols: Sequence[str]):
        self.cols, self.d = list(cols), len(cols) + 1
        self.start = (0.0,) * (self.d + self.d**2 + self.d**3)
        times = (np.arange(self.d) == 0).astype(int)
        pairs = np.add.outer(times, times)
        self.power = np.concatenate([times, pairs.ravel(), np.add.outer(pairs, times).ravel()])  # how often time occurs in each term

    def steps(self, s: Segment) -> np.ndarray:
        """Signatures from the row before the segment to each of its rows."""
        before = min(1, s.base)
        x = np.stack([s.padded(c, before) for c in self.cols], axis=1)
        return paths.signature_steps(np.column_stack([np.arange(len(x)), x]))[before:]

    def reduce(self, s: Segment) -> Sequence[float]:
        return self.steps(s)[-1]

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        return chen(state, found, self.d)


def _signed(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], rows: int, each: bool) -> DataFrame:
    """(by, len, sig) of every prefix, or of those that end a segment; time runs by rows."""
    step = Signature(cols)

    def replay(s: Segment) -> Arrays:
        own = step.steps(s)
        n = np.arange(s.base + 1, s.base + len(own) + 1)
        own, n = (own, n) if each else (own[-1:], n[-1:])
        full = chen(s.state[step.name], own, step.d)
        return {"len": n, "sig": pa.ListArray.from_arrays(np.arange(0, full.size + 1, full.shape[1], dtype=np.int32), pa.array(full.ravel()))}

    named = df.select(by, *order, *[F.col(c).cast("double").alias(c) for c in cols if c not in order])
    return scan(named, by, order, cols, [[step]], replay, "len int, sig array<double>", 1, rows)


def _timed(sig: str, length: str, power: np.ndarray) -> Column:
    """The signature with time running from 0 to 1 over ``length`` rows."""
    return F.zip_with(sig, F.array(*[F.lit(int(p)) for p in power]), lambda x, p: x / F.pow(F.greatest(F.col(length) - 1, F.lit(1)).cast("double"), p))


def signatures(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], rows: int = ROWS) -> DataFrame:
    """(by, sig): depth-3 signature of each key's path with time from 0 to 1 added. An only row has zeros."""
    last = _signed(df, by, order, cols, rows, False).groupBy(by).agg(F.max_by("sig", "len").alias("sig"), F.max("len").alias("len"))
    return last.select(by, _timed("sig", "len", Signature(cols).power).alias("sig"))


def prefix_signatures(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], first: int = 3, time_scale: str = "prefix", rows: int = ROWS) -> DataFrame:
    """(by, len, sig) of the prefixes of at least ``first`` rows. ``time_scale`` prefix lets time run from 0 to 1 over each prefix, so that
    equal paths have equal signatures; full lets it run over the whole path."""
    found = _signed(df, by, order, cols, rows, True).where(F.col("len") >= first)
    if time_scale == "full":
        size = df.groupBy(F.col(by).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
        found = found.join(size, F.col(by).eqNullSafe(F.col("_of")))
    return found.select(by, "len", _timed("sig", "_n" if time_scale == "full" else "len", Signature(cols).power).alias("sig"))
