"""Keyed state: incremental indicators, positions, risk gates, episodes.

Each processor keeps one small JSON value for a key, and map state where entries of tokens add up. Rows of a key are ordered by time within a micro-batch;
rows at or before the last time seen are late and ignored. Results do not depend on how batches are cut, as long
as rows arrive in time order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from copy import deepcopy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


ROWS = 10_000  # rows of a key that are Python objects at a time


class Entries:
    """Map state of bounded size as a dict while a key's rows of one micro-batch are worked on: read once, changes written back once. Asking the
    state store on each row costs a round trip to the JVM every time."""

    def __init__(self, state):
        self.state, self.was, self.now = state, {}, {}

    def read(self) -> None:
        self.was = {k[0]: v[0] for k, v in self.state.iterator()}
        self.now = dict(self.was)

    def write(self) -> None:
        for k in self.was.keys() - self.now.keys():
            self.state.removeKey((k,))
        for k, v in self.now.items():
            if self.was.get(k) != v:
                self.state.updateValue((k,), (v,))


def records(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch in order, in parts."""
    batch = pd.concat(list(rows)).sort_values(order)
    return (batch.iloc[at : at + ROWS] for at in range(0, len(batch), ROWS))


class Keyed(StatefulProcessor):
    """Base: ``step(state, row)`` changes the state and returns output rows (dicts) for each input row in order."""

    fresh: dict = {}
    columns: list[str] = []

    def __init__(self, key: str, order: list[str], **config):
        self.key, self.order, self.config = key, order, config

    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", "json string", self.ttl_ms)
        self.entries: list[Entries] = []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.value.get()[0]) if self.value.exists() else deepcopy(self.fresh)
        for e in self.entries:
            e.read()
        for part in records(rows, self.order):
            out = []
            for row in part.to_dict("records"):
                at = [float(row[c].timestamp()) if hasattr(row[c], "timestamp") else row[c] for c in self.order]
                if state.get("seen") is not None and at <= state["seen"]:
                    continue
                state["seen"] = at
                out += [{self.key: key[0], **r} for r in self.step(state, row)]
            yield pd.DataFrame(out, columns=[self.key, *self.columns])
        self.value.update((json.dumps(state),))
        for e in self.entries:
            e.write()

    def step(self, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Indicators(Keyed):
    """EMA, growth over p rows and run of falling rows, row by row (ema_13 and so on equal the batch kernels)."""

    columns = ["idx", "ema", "roc", "falling"]
    fresh = {"i": 0, "ema": None, "last": [], "falling": 0}

    def step(self, s: dict, row: dict) -> list[dict]:
        v, c = float(row[self.config["v"]]), self.config
        a = 2.0 / (c.get("span", 13) + 1)
        s["ema"] = v if s["ema"] is None else s["ema"] + a * (v - s["ema"])
        s["falling"] = s["falling"] + 1 if s["last"] and v < s["last"][-1] else 0
        p = c.get("p", 6)
        roc = v / s["last"][-p] - 1 if len(s["last"]) >= p and s["last"][-p] else None
        s["last"] = [*s["last"][-(p - 1) :], v] if p > 1 else [v]
        s["i"] += 1
        return [{"idx": s["i"] - 1, "ema": s["ema"], "roc": roc, "falling": s["falling"]}]


def growth(to: float, price: float) -> float:
    """Percent from a price: infinite from a price of 0, and no number from 0 to 0."""
    return (to / price - 1) * 100 if price else float("inf") if to > 0 else float("nan")


class Positions(Keyed):
    """Open on a signal, follow the peak, close by trailing stop, hard stop or time: emits closed trades."""

    columns = ["entry_idx", "exit_idx", "entry_value", "exit_value", "peak_value", "return_pct", "exit_reason"]
    fresh = {"i": -1, "open": None}

    def step(self, s: dict, row: dict) -> list[dict]:
        c, v = self.config, float(row[self.config["v"]])
        s["i"] += 1
        p = s["open"]
        if p is None:
            if row[c["signal"]]:
                s["open"] = {"i": s["i"], "price": v, "peak": v}
            return []
        p["peak"] = max(p["peak"], v)
        gain, held = (v / p["price"] - 1) * 100 if p["price"] > 0 else 0.0, s["i"] - p["i"]
        fall = (1 - v / p["peak"]) * 100 if p["peak"] > 0 else 0.0
        reason = "trailing_stop" if fall > c["stop"] else "hard_stop" if gain < -2 * c["stop"] else "time_stop" if held >= c["max_bars"] else None
        if reason is None:
            return []
        s["open"] = None
        return [{"entry_idx": p["i"], "exit_idx": s["i"], "entry_value": p["price"], "exit_value": v, "peak_value": p["peak"], "return_pct": growth(v, p["price"]), "exit_reason": reason}]


class PartialPositions(Keyed):
    """Positions sold in parts by an action column, force-closed after ``max_bars``: emits every sale."""

    columns = ["entry_idx", "idx", "action", "sold", "remaining", "realized"]
    fresh = {"i": -1, "open": None}

    def step(self, s: dict, row: dict) -> list[dict]:
        c, v = self.config, float(row[self.config["v"]])
        s["i"] += 1
        p = s["open"]
        if p is None:
            if row[c["signal"]]:
                s["open"] = {"i": s["i"], "price": v, "left": 1.0, "made": 0.0}
            return []
        late = s["i"] - p["i"] >= c["max_bars"]
        action = "EXIT" if late else row[c["action"]]
        sold = min(c["fractions"].get(action, 0.0), p["left"])
        if sold <= 0:
            return []
        p["left"] -= sold
        p["made"] += sold * (v - p["price"]) / max(p["price"], 1)
        out = {"entry_idx": p["i"], "idx": s["i"], "action": action, "sold": sold, "remaining": p["left"], "realized": p["made"]}
        if p["left"] <= 0.001:
            s["open"] = None
        return [out]


class RiskGate(Keyed):
    """Portfolio limits, keyed by portfolio: candidates (kind open) pass if open positions, capital, trades of the day,
    loss of the day, win rate of the last closed trades and the token's cool-down allow it; closes (kind close) with
    their profit update the state. Emits the decision on each candidate. Counters of the day restart at midnight. Open positions and
    closing times are map state: at most ``max_open`` entries and those of about a day and a cool-down."""

    columns = ["token", "ok", "reason"]
    fresh = {"held": 0, "capital": None, "day": None, "n": 0, "loss": 0.0, "results": []}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = Entries(handle.getMapState("open", "token string", "size double"))
        self.closed = Entries(handle.getMapState("closed", "token string", "at double"))
        self.entries = [self.open, self.closed]

    def step(self, s: dict, row: dict) -> list[dict]:
        c, token = self.config, str(row[self.config["token"]])
        t = float(row[self.order[0]].timestamp())
        s["capital"] = c["capital"] if s["capital"] is None else s["capital"]
        if s["day"] != int(t // 86400):
            s["day"], s["n"], s["loss"] = int(t // 86400), 0, 0.0
            self.closed.now = {k: at for k, at in self.closed.now.items() if t - at < c["cooldown"]}  # once a day
        held = self.open.now.get(token)
        if row["kind"] == "close":
            if held is not None:
                pnl = float(row["pnl"])
                del self.open.now[token]
                s["held"] -= 1
                s["capital"] += held + pnl
                s["loss"] += min(pnl, 0.0)
                s["results"] = [*s["results"], pnl > 0][-c["window"] :]
                self.closed.now[token] = t
            return []
        poor = len(s["results"]) == c["window"] and sum(s["results"]) < c["min_win_rate"] * c["window"]
        cooling = token in self.closed.now and t - self.closed.now[token] < c["cooldown"]
        rules = [("already_open", held is not None), ("max_open", s["held"] >= c["max_open"]), ("capital", s["capital"] < c["size"]), ("daily_loss", -s["loss"] >= c["max_loss"]), ("trades_per_day", s["n"] >= c["max_trades"]), ("win_rate", poor), ("cooldown", cooling)]
        reason = next((name for name, hit in rules if hit), None)
        if reason is None:
            self.open.now[token] = c["size"]
            s["held"], s["capital"], s["n"] = s["held"] + 1, s["capital"] - c["size"], s["n"] + 1
        return [{"token": token, "ok": reason is None, "reason": reason}]


class Episodes(Keyed):
    """Episodes of growth (see ``kernels.trades.episodes``): emits each when it ends; ``running`` is not emitted."""

    columns = ["entry_idx", "exit_idx", "duration", "entry_value", "peak_value", "exit_value"]
    fresh = {"i": -1, "open": None}

    def step(self, s: dict, row: dict) -> list[dict]:
        c, v, roc = self.config, float(row[self.config["v"]]), row[self.config["roc"]]
        s["i"] += 1
        if roc is None or roc != roc:
            return []
        p = s["open"]
        if p is None:
            if roc > c["min_roc"]:
                s["open"] = {"i": s["i"], "price": v, "peak": v}
            return []
        p["peak"] = max(p["peak"], v)
        if v >= p["price"] and (1 - v / p["peak"]) * 100 <= c["max_fall"]:
            return []
        s["open"] = None
        n = s["i"] - p["i"]
        return [{"entry_idx": p["i"], "exit_idx": s["i"], "duration": n, "entry_value": p["price"], "peak_value": p["peak"], "exit_value": v}] if n >= c["min_bars"] else []


SCHEMAS = {
    Indicators: "idx bigint, ema double, roc double, falling bigint",
    Positions: "entry_idx bigint, exit_idx bigint, entry_value double, exit_value double, peak_value double, return_pct double, exit_reason string",
    PartialPositions: "entry_idx bigint, idx bigint, action string, sold double, remaining double, realized double",
    RiskGate: "token string, ok boolean, reason string",
    Episodes: "entry_idx bigint, exit_idx bigint, duration bigint, entry_value double, peak_value double, exit_value double",
}


def stream_state(df: DataFrame, key: str, order: list[str], kind: type[Keyed], ttl_ms: int | None = None, **config) -> DataFrame:
    """Run a processor over a stream, keyed by ``key``; needs the RocksDB state store (``windows.use_rocksdb``). With ``ttl_ms`` the state of a
    key that had no row for so long (processing time) is dropped and its next row starts afresh: for keys that never come back (a query that ends by itself needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, since processing time always asks for another batch).
    What must act at a point of event time is in ``timed``."""
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[key], *T._parse_datatype_string(f"struct<{SCHEMAS[kind]}>").fields])
    processor = kind(key, order, **config)
    processor.ttl_ms = ttl_ms
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime" if ttl_ms else "none")
