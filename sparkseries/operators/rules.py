"""Positions sold in parts by declared rule tables.

A rule is an action, the part of the whole position that it sells, and a condition on a row's columns, as SQL text. The first rule that holds counts. Parts do
not depend on what was sold before, so what is left of a position is 1 minus the sum of the parts so far, not below 0: a running sum, without a
loop over rows. Where they do (a rule with ``late``), the rows of a position are folded in order. Rules and their bounds belong to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    action: str
    part: float
    when: str
    late: tuple[str, float] | None = None  # action and part once half of the position or less is left


def position(df: DataFrame, key: str, order: Sequence[str], v: str) -> DataFrame:
    """Adds the state of a position opened at each key's first row: gain, off_peak (change from the running maximum) and best (largest gain so far, 0 at least)."""
    w = Window.partitionBy(key).orderBy(*order)
    first, top = F.first(v).over(w), F.max(v).over(w)
    gain = (F.col(v) - first) / F.greatest(first, F.lit(1.0))
    return df.withColumns({"gain": gain, "off_peak": F.when(top > 0, F.col(v) / top - 1).otherwise(0.0)}).withColumn("best", F.greatest(F.lit(0.0), F.max("gain").over(w)))


def first_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Action and part of the first rule that holds (HOLD and 0 if none does; a null condition does not hold)."""
    action, part = F.lit("HOLD"), F.lit(0.0)
    for r in reversed(rules):
        holds = F.coalesce(F.expr(r.when), F.lit(False))
        action, part = F.when(holds, F.lit(r.action)).otherwise(action), F.when(holds, F.lit(float(r.part))).otherwise(part)
    return action, part


def ladder_part(key: str, order: Sequence[str], gain: str, steps: Sequence[tuple[float, float]]) -> Column:
    """The part that a ladder of (gain, part) sells on a row: each step once, when its gain is first reached (from below for gains, from above for losses)."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(0.0)
    for at, part in steps:
        reached = (F.col(gain) >= at) & F.coalesce(F.max(gain).over(before) < at, F.lit(True)) if at > 0 else (F.col(gain) <= at) & F.coalesce(F.min(gain).over(before) > at, F.lit(True))
        total = total + F.when(reached, F.lit(float(part))).otherwise(0.0)
    return total


def sell(df: DataFrame, key: str, order: Sequence[str], part: Column, action: Column | None = None) -> DataFrame:
    """Adds before, sold and after, the shares of the position on each row, and ``action`` (HOLD where nothing is left to sell)."""
    prior = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_part", part).withColumn("before", F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("_part").over(prior), F.lit(0.0))))
    out = out.withColumn("sold", F.least("_part", "before")).withColumn("after", F.col("before") - F.col("sold"))
    return (out if action is None else out.withColumn("action", F.when(F.col("sold") > 0, action).otherwise("HOLD"))).drop("_part")


def sell_by_share(df: DataFrame, key: str, order: Sequence[str], rules: Sequence[Rule], *keep: str) -> DataFrame:
    """(key, *order, *keep, before, action, sold, after) under rules that may depend on the share that is left. What each row sells above half and from
    half on is known by itself; a fold over the key's rows picks between the two. The rows of a key (a bounded holding time) meet in one array."""
    early, late = first_rule(rules), first_rule([Rule(*r.late, r.when) if r.late else r for r in rules])
    rows = df.select(key, *order, *keep, early[0].alias("_a1"), early[1].alias("_p1"), late[0].alias("_a2"), late[1].alias("_p2"))

    def step(s: Column, x: Column) -> Column:
        left = s["left"]
        return F.struct(F.greatest(F.lit(0.0), left - F.when(left > 0.5, x["_p1"]).otherwise(x["_p2"])).alias("left"), F.concat(s["before"], F.array(left)).alias("before"))

    start = F.struct(F.lit(1.0).alias("left"), F.expr("CAST(array() AS array<double>)").alias("before"))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rows.columns[1:]))).alias("r")).withColumn("before", F.aggregate("r", start, step, lambda s: s["before"]))
    out = held.select(key, F.explode(F.arrays_zip("r", "before")).alias("x")).select(key, "x.r.*", "x.before")
    out = out.withColumn("sold", F.least("before", F.when(F.col("before") > 0.5, F.col("_p1")).otherwise(F.col("_p2")))).withColumn("after", F.col("before") - F.col("sold"))
    action = F.when(F.col("before") > 0.5, F.col("_a1")).when(F.col("before") > 0, F.col("_a2")).otherwise("HOLD")
    return out.select(key, *order, *keep, "before", action.alias("action"), "sold", "after")


def outcome(df: DataFrame, key: str, order: Sequence[str], slippage: float = 0.03) -> DataFrame:
    """(key, ret, n_sales, held): return of each position, what is left closed on its last row; rows until nothing was left."""
    at = F.struct(*order)
    rest = F.max_by(F.col("after") * F.col("gain"), at)
    empty = F.min(F.when(F.col("after") <= 0, F.col("_n")))
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.groupBy(key).agg(((F.sum(F.col("sold") * F.col("gain")) + rest) * (1 - slippage)).alias("ret"), F.count(F.when(F.col("sold") > 0, 1)).cast("int").alias("n_sales"), F.coalesce(empty, F.max("_n")).cast("int").alias("held"))


def managed(df: DataFrame, key: str, order: Sequence[str], rules: Sequence[Rule], slippage: float = 0.03) -> DataFrame:
    """Outcome of positions (see ``position``) under a rule table."""
    action, part = first_rule(rules)
    return outcome(sell(df, key, order, part, action), key, order, slippage)
