"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with share w of the target and n of the N rows is repeated r = w * N / n times on average. Each
row's count is Poisson(r), inverted from a uniform number hashed from (seed, id, text), so it needs no state,
no second pass and gives the same mix on every run. Rows are exploded by their count and dealt out
globally by a hash of (seed, row, copy), which shuffles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._state import counted

MAX_BROADCAST_SOURCES, MAX_BROADCAST_STEPS = 10_000, 1_000_000


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of the parts (52 bits)."""
    hashed = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, power: float, scale: float) -> DataFrame:
    """(source, rows, rate, cdf): cdf lists P(count <= k) for k = 0.. until the tail is below 1e-15.

    Target shares are ``weights`` (sources that are not named get none) or, without it, proportional to
    rows ** power.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        shares = sizes.withColumn("w", F.pow("rows", F.lit(power)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        shares = sizes.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source").cast("string")], F.lit(0.0)) if pairs else F.lit(0.0))
    total = shares.agg(F.sum("w").alias("all_w"), F.sum("rows").alias("all_rows"))
    rate = F.when(F.col("all_w") > 0, F.lit(scale) * F.col("w") / F.col("all_w") * F.col("all_rows") / F.col("rows")).otherwise(0.0)
    out = shares.crossJoin(F.broadcast(total)).select("source", "rows", rate.alias("rate"))  # total is one row
    out = out.withColumn("upto", F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20)).otherwise(-1).cast("int"))
    own = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # the k of one source: bounded by its rate
    terms = out.where("upto >= 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("upto"))))
    terms = terms.withColumn("p", F.exp(-F.col("rate") + F.when(F.col("k") > 0, F.col("k") * F.log("rate")).otherwise(0.0) - F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(own)))
    terms = terms.withColumn("c", F.sum("p").over(own))
    cdf = terms.groupBy("source", "rows", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    return cdf.unionByName(out.where("upto < 0").select("source", "rows", "rate", F.array(F.lit(2.0)).alias("cdf")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", power: float = 0.5, scale: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` replicated to the target weights, with copy (int, from 0) and mix_order (double) added.

    Null sources form a source of their own (only ``weights=None`` gives it a share). Repeated rows have
    equal counts; every copy of every row is kept. Null texts and ids hash as fixed marks. Input
    columns called copy or mix_order are replaced; all others pass through, whatever their names. Empty tables give an empty
    result. The rates table is broadcast only if it has at most MAX_BROADCAST_SOURCES sources and
    MAX_BROADCAST_STEPS steps of distributions, else joined by shuffle. A row's work is in proportion to its source's rate.
    """
    names = [c for c in docs.columns if c not in ("copy", "mix_order")]
    by_source, seen = counted(rates(docs, weights, source_col, power, scale).select(F.col("source").alias("of"), "cdf"), "rates", steps=F.sum(F.size("cdf")))
    few = seen["rows"] <= MAX_BROADCAST_SOURCES and (seen["steps"] or 0) <= MAX_BROADCAST_STEPS
    key = F.concat_ws("|", F.coalesce(docs[id_col].cast("string"), F.lit("~")), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("~"))))
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[source_col].alias("own"), key.alias("key"))
    joined = rows.join(F.broadcast(by_source) if few else by_source, F.col("own").eqNullSafe(F.col("of")))
    counts = joined.withColumn("u", uniform(F.lit(seed), F.col("key"))).withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    copies = counts.where("n > 0").select("row", "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    ordered = copies.select("row.*", "copy", uniform(F.lit(seed + 1), F.col("key"), F.col("copy")).alias("mix_order"))
    return ordered.repartition(F.col("mix_order")).sortWithinPartitions("mix_order")
