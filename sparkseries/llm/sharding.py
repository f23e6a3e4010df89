"""Sharding by extendible hashing.

Every row has a 60-bit hash of its key. The directory starts with one bucket; a bucket whose rows
exceed the byte limit splits on the next hash bit, others stay as they are, until every shard fits. The
splits are found from a histogram: bytes by hash prefix are summed once at a fine depth and rolled up, so only
(prefix, bytes) partial sums are shuffled. Cells of the histogram that are still too large
are refined deeper; what shares all hash bits and still exceeds the limit (repeated keys) is dealt into
numbered pieces by running size, and a single row above the limit is a piece of its own.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._state import counted, written

BITS, STEP = 60, 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's md5, as a bigint (null keys hash like the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _prefix(depth: str) -> Column:
    return F.expr(f"shiftright(bits, {BITS} - {depth})")


def directory(cells: DataFrame, limit: int, depth: int, base: int) -> DataFrame:
    """From bytes by prefix of ``depth`` bits: (cell, depth of its leaf, bytes of the leaf); a leaf is the
    shortest prefix of more than ``base`` bits or equal that fits, or the cell itself if nothing does."""
    every = cells.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(depth))))
    sums = every.groupBy("d", F.expr(f"shiftright(cell, {depth} - d)").alias("p")).agg(F.sum("bytes").alias("bytes"))
    fits = every.select("cell", "d", F.expr(f"shiftright(cell, {depth} - d)").alias("p")).join(sums, ["d", "p"])
    return fits.groupBy("cell").agg(F.min(F.when((F.col("bytes") <= limit) | (F.col("d") == depth), F.struct("d", "bytes"))).alias("leaf")).select("cell", F.col("leaf.d").alias("d"), F.col("leaf.bytes").alias("shard_bytes"))


def _pieces(stuck: DataFrame, limit: int) -> DataFrame:
    """Deal rows of one key: into salted lots of about a quarter of the limit, each cut by running size.

    The rows are written first, so that a task that runs again deals its rows to the same lots.
    """
    half = max(1, limit // 2)
    fixed = written(stuck, "stuck").withColumn("at", F.monotonically_increasing_id())
    lot = F.pmod(F.xxhash64("at"), F.ceil(F.col("shard_bytes") * 4 / limit))
    lots = fixed.withColumn("lot", lot).withColumn("large", F.col("bytes") > half)
    w = Window.partitionBy("bits", "lot", "large").orderBy("bytes", "at").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("large"), F.count("*").over(w)).otherwise(F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / half))
    named = lots.withColumn("shard", F.concat("shard", F.lit("+"), F.col("lot").cast("string"), F.when(F.col("large"), "L").otherwise("S"), cut.cast("string")))
    return named.withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("shard"))).select(*stuck.columns)


def assign(docs: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns shard (string), shard_depth (int) and shard_bytes (bigint).

    ``shard`` is the bucket's hash prefix in binary ("" for the whole table), followed by ``+`` and a
    piece name for a bucket that hash bits cannot split. A row's size is the UTF-8 length of its text
    (null: 0). No shard exceeds ``limit_bytes`` unless it is one single larger row. Repeated rows are
    all kept. An empty table gives an empty result. Input columns called shard, shard_depth or
    shard_bytes are replaced; all others pass through, whatever their names.
    """
    names = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    sized = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), hash_bits(docs[key_col]).alias("bits"), row_bytes(docs[text_col]).alias("bytes"))
    sizes, seen = counted(sized.select("bits", "bytes"), "sizes", total=F.sum("bytes"))
    base, leaves, left = 0, None, sizes
    depth = min(BITS, max(1, ceil(log2(max(2, (seen["total"] or 0) / limit_bytes)))) + 3)
    widths = []
    while True:
        cells = left.groupBy(_prefix(str(depth)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        over = F.col("shard_bytes") > limit_bytes
        found, seen = counted(directory(cells, limit_bytes, depth, base).withColumn("w", F.lit(depth)), "directory", over=F.max(over & (F.col("d") == depth)))
        some = depth < BITS and bool(seen["over"])
        big = found.where(over & (F.col("d") == depth))
        fine = found.where(~over | (F.col("d") < depth)) if some else found
        leaves = fine if leaves is None else leaves.unionByName(fine)
        widths.append(depth)
        if not some:
            break
        left = left.withColumn("cell", _prefix(str(depth))).join(big.select("cell"), "cell", "left_semi").drop("cell")
        base, depth = depth + 1, min(BITS, depth + STEP)
    stuck = depth == BITS and bool(seen["over"])
    placed = sized
    for w in widths:  # the directory is as large as the number of shards, not of rows
        of_cell = leaves.where(F.col("w") == w).select(F.col("cell").alias(f"cell{w}"), F.struct("d", "shard_bytes").alias(f"leaf{w}"))
        placed = placed.withColumn(f"cell{w}", _prefix(str(w))).join(of_cell, f"cell{w}", "left")
    placed = placed.withColumn("leaf", F.coalesce(*[F.col(f"leaf{w}") for w in widths])).select("row", "bits", "bytes", F.col("leaf.d").alias("d"), F.col("leaf.shard_bytes").alias("shard_bytes"))
    name = F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr(f"lpad(conv(shiftright(bits, {BITS} - d), 10, 2), d, '0')"))
    out = placed.select("row", name.alias("shard"), F.col("d").cast("int").alias("shard_depth"), "shard_bytes", "bits", "bytes")
    if stuck:
        out = out.where(F.col("shard_bytes") <= limit_bytes).unionByName(_pieces(out.where(F.col("shard_bytes") > limit_bytes), limit_bytes))
    return out.select("row.*", "shard", "shard_depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet with one folder for each shard (``shard=<prefix>``)."""
    placed = assign(docs, limit_bytes, key_col, text_col)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
