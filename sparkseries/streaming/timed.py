"""Keyed state that acts at points of event time, also without a new row of its key.

A processor names the next point at which its state must act (its deadline). Before each row every deadline that lies before
the row's time is acted on, and one timer stands at the next; it fires when the watermark has passed it. So a
result does not depend on whether a row or the watermark came first, nor on how micro-batches are cut, as long as the rows of a key
arrive in time order. State has declared columns; collections are map state.

Processors can be chained in one query: ``stream_timed(..., event_time=...)`` names the output column that carries event time, and
the watermark passes on to the next stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import Entries, records


def _plain(x):
    """A Python value for a state column."""
    return None if x is None or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x


def _names(fields: str) -> list[str]:
    return T._parse_datatype_string(f"struct<{fields}>").names


class Timed(StatefulProcessor):
    """Base. ``fields`` declares the state (a new key has ``fresh``), ``columns`` the output behind the key; ``carry`` names input columns that
    ``step`` may hand on. Rows at or before the last one of their key are late and ignored."""

    fields = ""
    columns = ""
    fresh: dict = {}

    def __init__(self, key: str, order: list[str], carry: list[str], **config):
        self.key, self.order, self.carry, self.config = key, order, carry, config
        self.names, self.out = _names(self.fields), [*carry, *_names(self.columns)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", f"seen bigint, tie bigint, {self.fields}")

    def load(self) -> dict:
        names = ["seen", "tie", *self.names]
        return dict(zip(names, map(_plain, self.value.get()))) if self.value.exists() else {**dict.fromkeys(names), **self.fresh}

    def store(self, s: dict, before: int | None) -> None:
        now = self.deadline(s)
        if now != before:
            if before is not None:
                self.handle.deleteTimer(before + 1)
            if now is not None:
                self.handle.registerTimer(now + 1)
        self.value.update(tuple(s[n] for n in ["seen", "tie", *self.names]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.load()
        before = self.deadline(s)
        ts, tie = self.order
        for part in records(rows, self.order):
            at = part[ts].dt.as_unit("us").astype("int64").tolist()
            out = []
            for us, n, row in zip(at, part[tie].tolist(), part.to_dict("records")):
                if s["seen"] is not None and (us, n) <= (s["seen"], s["tie"]):
                    continue
                out += self.until(s, us // 1000)
                out += self.step(s, row, us // 1000)
                s["seen"], s["tie"] = us, n
            yield self.frame(key, out)
        self.store(s, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.load()
        out = self.until(s, timerValues.getCurrentWatermarkInMs())
        self.store(s, expiredTimerInfo.getExpiryTimeInMs() - 1)
        yield self.frame(key, out)

    def until(self, s: dict, ms: int) -> list[dict]:
        """Act on every deadline before ``ms``."""
        out = []
        while (due := self.deadline(s)) is not None and due < ms:
            out += self.expire(s, due)
        return out

    def frame(self, key, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(out), **{n: [r[n] for r in out] for n in self.out}}, dtype=object)

    def step(self, s: dict, row: dict, ms: int) -> list[dict]:
        raise NotImplementedError

    def deadline(self, s: dict) -> int | None:
        return None

    def expire(self, s: dict, due: int) -> list[dict]:
        return []

    def close(self) -> None:
        pass


class Growth(Timed):
    """Growth over ``p`` rows of a key, in percent, handed on with the carried columns of the row: the first of two chained steps."""

    fields = "last array<double>"
    columns = "roc double"
    fresh = {"last": ()}

    def load(self) -> dict:
        s = super().load()
        return s | {"last": [float(x) for x in s["last"]]}

    def step(self, s: dict, row: dict, ms: int) -> list[dict]:
        v, p = float(row[self.config["v"]]), self.config["p"]
        roc = (v / s["last"][-p] - 1) * 100 if len(s["last"]) >= p and s["last"][-p] else None
        s["last"] = [*s["last"], v][-p:]
        return [{c: row[c] for c in self.carry} | {"roc": roc}]


class Episodes(Timed):
    """Episodes of growth: open while growth exceeds ``min_roc``, over at a value below the entry's or more than ``max_fall`` percent below the peak
    (``observed``). An open episode whose key is silent for ``idle_ms`` is censored: it ends at its last row with ``observed`` false, on the next row
    or when the watermark passes. Episodes under ``min_bars`` rows are left out."""

    fields = "i bigint, entry bigint, price double, peak double, now double"
    columns = "entry_idx bigint, exit_idx bigint, duration bigint, entry_value double, peak_value double, exit_value double, observed boolean"
    fresh = {"i": -1}

    def ended(self, s: dict, at: int, v: float, observed: bool) -> list[dict]:
        n, out = at - s["entry"], {"entry_idx": s["entry"], "exit_idx": at, "duration": at - s["entry"], "entry_value": s["price"], "peak_value": s["peak"], "exit_value": v, "observed": observed}
        s["entry"] = None
        return [out] if n >= self.config["min_bars"] else []

    def step(self, s: dict, row: dict, ms: int) -> list[dict]:
        c, v, roc = self.config, float(row[self.config["v"]]), _plain(row[self.config["roc"]])
        s["i"], s["now"] = s["i"] + 1, v
        if roc is None:
            return []
        if s["entry"] is None:
            if roc > c["min_roc"]:
                s["entry"], s["price"], s["peak"] = s["i"], v, v
            return []
        s["peak"] = max(s["peak"], v)
        if v >= s["price"] and (1 - v / s["peak"]) * 100 <= c["max_fall"]:
            return []
        return self.ended(s, s["i"], v, True)

    def deadline(self, s: dict) -> int | None:
        return None if s["entry"] is None else s["seen"] // 1000 + self.config["idle_ms"]

    def expire(self, s: dict, due: int) -> list[dict]:
        return self.ended(s, s["i"], s["now"], False)


class TimedPositions(Timed):
    """Positions with a longest holding time in event time: opened by a signal, closed by a fall from the peak, or at ``hold_ms`` after the entry by a timer,
    at the last value known then."""

    fields = "i bigint, entry bigint, since bigint, price double, peak double, now double"
    columns = "entry_idx bigint, exit_idx bigint, entry_value double, exit_value double, peak_value double, exit_ms bigint, exit_reason string"
    fresh = {"i": -1}

    def closed(self, s: dict, ms: int, reason: str) -> list[dict]:
        out = {"entry_idx": s["entry"], "exit_idx": s["i"], "entry_value": s["price"], "exit_value": s["now"], "peak_value": s["peak"], "exit_ms": ms, "exit_reason": reason}
        s["entry"] = None
        return [out]

    def step(self, s: dict, row: dict, ms: int) -> list[dict]:
        v = float(row[self.config["v"]])
        s["i"], s["now"] = s["i"] + 1, v
        if s["entry"] is None:
            if row[self.config["signal"]]:
                s["entry"], s["since"], s["price"], s["peak"] = s["i"], ms, v, v
            return []
        s["peak"] = max(s["peak"], v)
        # 0 / 0 counts as a fall, as in SQL, where no number is above every number
        return self.closed(s, ms, "trailing_stop") if not s["peak"] or (1 - v / s["peak"]) * 100 > self.config["stop"] else []

    def deadline(self, s: dict) -> int | None:
        return None if s["entry"] is None else s["since"] + self.config["hold_ms"]

    def expire(self, s: dict, due: int) -> list[dict]:
        return self.closed(s, due, "time_stop")


class Watchlist(Timed):
    """Watch-list of at most ``max_size`` tokens of a key: a token that is not on it is added, the oldest gives way (``full``), and an entry leaves
    ``ttl_ms`` after it was added (``expired``), with or without a new row. Entries are map state, read and written once for a key's rows of a micro-batch; the output is the log of changes."""

    fields = "size int, first bigint"
    columns = "token string, at_ms bigint, change string"
    fresh = {"size": 0}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = Entries(handle.getMapState("entries", "token string", "at bigint"))

    def load(self) -> dict:
        self.entries.read()
        return super().load()

    def store(self, s: dict, before: int | None) -> None:
        self.entries.write()
        super().store(s, before)

    def oldest(self) -> tuple[int, str] | None:
        """Of at most ``max_size`` entries."""
        return min(((at, token) for token, at in self.entries.now.items()), default=None)

    def dropped(self, s: dict, at: int, change: str) -> list[dict]:
        token = self.oldest()[1]
        del self.entries.now[token]
        s["size"] -= 1
        first = self.oldest()
        s["first"] = first and first[0]
        return [{"token": token, "at_ms": at, "change": change}]

    def step(self, s: dict, row: dict, ms: int) -> list[dict]:
        token = str(row[self.config["token"]])
        if token in self.entries.now:
            return []
        out = self.dropped(s, ms, "full") if s["size"] >= self.config["max_size"] else []
        self.entries.now[token] = ms
        s["size"], s["first"] = s["size"] + 1, ms if s["first"] is None else s["first"]
        return [*out, {"token": token, "at_ms": ms, "change": "added"}]

    def deadline(self, s: dict) -> int | None:
        return None if s["first"] is None else s["first"] + self.config["ttl_ms"]

    def expire(self, s: dict, due: int) -> list[dict]:
        return self.dropped(s, due, "expired")


def stream_timed(df: DataFrame, key: str, order: list[str], kind: type[Timed], carry: list[str] = (), event_time: str = "", **config) -> DataFrame:
    """Run a processor over a stream that has a watermark on ``order[0]``; ``order`` is a time and a whole number for ties. ``event_time`` names the
    carried column that a next stateful operator may use as its time. Needs the RocksDB state store (``windows.use_rocksdb``)."""
    schema = T.StructType([df.schema[key], *[df.schema[c] for c in carry], *T._parse_datatype_string(f"struct<{kind.columns}>").fields])
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=kind(key, order, list(carry), **config), outputStructType=schema, outputMode="append", timeMode="eventTime", eventTimeColumnName=event_time)
