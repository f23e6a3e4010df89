"""Declared schemas of landed payloads and operational tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    """Schema from ``name type, ...`` with simple types, without a session."""
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "counts": T.MapType(T.StringType(), T.LongType()), "strings": T.ArrayType(T.StringType()), "longs": T.ArrayType(T.LongType()), "doubles": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in text.split(", "))])


REGISTRY_4 = _struct("address string, chain string, name string, symbol string")
REGISTRY_3 = _struct("address string, symbol string, name string")
CANDLE = _struct("time string, open string, high string, low string, close string, volume string, amount string")
CANDLES = T.StructType([T.StructField("data", T.StructType([T.StructField("list", T.ArrayType(CANDLE))]))])
POINT = _struct("timestamp long, value string")
TRENDS = T.StructType([T.StructField("data", T.StructType([T.StructField("trends", T.StructType([T.StructField("holder_count", T.ArrayType(POINT)), T.StructField("top10_holder_percent", T.ArrayType(POINT))]))]))])
HOLDERS = _struct("timestamp string, totalHolders long, netHolderChange long, holderPercentChange double, newHoldersByAcquisition counts, holdersIn counts, holdersOut counts")
COLUMNAR = _struct("t longs, o doubles, h doubles, l doubles, c doubles, volume strings, buyVolume strings, sellVolume strings, liquidity strings, buyers longs, sellers longs, buys longs, sells longs, transactions longs")
FLAT_BAR = _struct("timestamp long, open string, high string, low string, close string, volume string, buy_volume string, sell_volume string, liquidity string, buyers long, sellers long, buys long, sells long, transactions long")

TRADES = _struct("id long, address string, symbol string, entry_time timestamp, exit_time timestamp, entry_value double, exit_value double, size double, pnl double, return_pct double, exit_reason string, entry_signals string, exit_signals string")
POSITIONS = _struct("address string, symbol string, entry_time timestamp, entry_value double, peak_value double, bars_held int, remaining double, size double")
WATCHLIST = _struct("address string, symbol string, added timestamp, reason string, active boolean")
CANDIDATES = _struct("address string, symbol string, created timestamp, value double, holders long, score double, scored timestamp, details string")
TICK_LOG = _struct("ts timestamp, address string, action string, detail string")
EQUITY_LOG = _struct("ts timestamp, capital double, equity double, open_positions int")
SCAN_LOG = _struct("scan long, ts timestamp, l0 int, l1 int, l2 int, entered int")
TABLES = {"trades": TRADES, "positions": POSITIONS, "watchlist": WATCHLIST, "candidates": CANDIDATES, "tick_log": TICK_LOG, "equity_log": EQUITY_LOG, "scan_log": SCAN_LOG}
