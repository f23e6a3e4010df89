"""Repeated passages across documents: relative Lempel-Ziv parsing against the whole corpus.

Reference index. The corpus is cut into overlapping reference blocks at content-defined anchors: of the
8-word seeds inside a window of ``window`` words, the one with the smallest hash is the window's anchor,
and consecutive windows with one anchor form a block (at most ``2 * window - seed`` words). Equal
passages have equal anchors wherever they stand, so every document can be parsed against every
indexed block by joining on the anchor's seed, without comparing documents with each other.

Parse. A block whose seed occurs once starts no long factor and is dropped. If a seed occurs more often and
always with the same block, the whole block is matched; so is a block that itself occurs again under a seed
with different blocks. What is left meets the end of a factor: there one occurrence of each different block
of the seed is compared window by window (the check at factor boundaries). Going
through a document from left to right, a factor is extended while the next match continues in the same
reference document at the same distance; otherwise the next factor begins. Factors are at least
``window`` words long by construction and become duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import written
from ._words import U, Words, signed, slices

SEED = 8


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("rid"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))


def _anchors(w: Words, total: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window that fits its text, its anchor (leftmost smallest seed), and all seeds."""
    left = w.left()
    g = np.full(len(left), np.iinfo(np.uint64).max, U)
    at = np.flatnonzero(left >= seed)
    g[at] = w.ranges(total, at, seed)
    span, step = window - seed + 1, 1
    least = np.arange(len(g))
    while step * 2 <= span:
        a, b = least[:-step], least[step:]
        least = np.where(g[a] <= g[b], a, b)
        step *= 2
    if span > step:
        a, b = least[: len(least) - (span - step)], least[span - step :]
        least = np.where(g[a] <= g[b], a, b)
    fits = np.flatnonzero(left >= window)
    return fits, least[fits], g


def blocks(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> DataFrame:
    """The reference blocks: (seed, block, rid, th, start, n), n windows from word ``start`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column(2)):
                if len(w.start) < window:
                    continue
                total = w.sums()
                fits, anchor, g = _anchors(w, total, window, seed)
                if not len(fits):
                    continue
                new = np.ones(len(fits), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(fits)))
                start, doc = fits[first], w.text_of[fits[first]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(g[anchor[first]])), pa.array(signed(w.ranges(total, start, n + window - 1))), batch.column(0).take(pa.array(doc + a)),
                    batch.column(1).take(pa.array(doc + a)), pa.array((start - w.offsets[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["seed", "block", "rid", "th", "start", "n"])

    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("block", T.LongType()), T.StructField("rid", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])
    return _rows(docs, id_col, text_col).mapInArrow(run, schema)


def _window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """(h, rid, th, start) of the windows listed in ``texts(rid, th, text, runs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            for a, b, w in slices(batch.column(2)):
                total, at, doc = w.sums(), [], []
                for i in range(a, b):
                    x = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs[i].as_py()]))
                    at.append(x + w.offsets[i - a])
                    doc.append(np.full(len(x), i))
                at, doc = np.concatenate(at), np.concatenate(doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(w.ranges(total, at, window))), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)),
                    pa.array((at - w.offsets[doc - a]).astype(np.int32))], names=["h", "rid", "th", "start"])

    schema = T.StructType([T.StructField("h", T.LongType()), texts.schema["rid"], texts.schema["th"], T.StructField("start", T.IntegerType())])
    return texts.select("rid", "th", "text", "runs").mapInArrow(run, schema)


def matches(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> DataFrame:
    """Matched runs of windows with their reference: (rid, th, start, n, ref_id, ref_start).

    The reference is the occurrence in the smallest id (any of them if that text holds several).
    """
    index = blocks(docs, id_col, text_col, window, seed)
    seen = (index.groupBy("seed").agg(F.count("*").alias("times"), F.min("block").alias("lo"), F.max("block").alias("hi"), F.min("rid").alias("ref_id"), F.min_by("start", "rid").alias("ref_start"))
            .where("times > 1").select("seed", (F.col("lo") != F.col("hi")).alias("mixed"), "ref_id", "ref_start"))
    seen = written(seen, "seeds")  # apart from the join, whose hot seeds can then be split
    hits = written(index.join(seen, "seed"), "hits")
    mixed = hits.where("mixed")
    own = written(mixed.groupBy("seed", "block").agg(F.count("*").alias("times"), F.min(F.struct("rid", "th", "start")).alias("x"), F.max("n").alias("n"))
                  .select("seed", "block", "times", "n", F.col("x.rid").alias("ref_id"), F.col("x.th").alias("ref_th"), F.col("x.start").alias("ref_start")), "blocks")
    whole = hits.where("not mixed").select("rid", "th", "start", "n", "ref_id", "ref_start").unionByName(
        mixed.drop("ref_id", "ref_start").join(own.where("times > 1").select("seed", "block", "ref_id", "ref_start"), ["seed", "block"]).select("rid", "th", "start", "n", "ref_id", "ref_start"))
    edges = own.groupBy(F.col("ref_id").alias("e_rid"), F.col("ref_th").alias("e_th")).agg(F.collect_set(F.struct(F.col("ref_start").alias("start"), "n")).alias("runs"))
    edge_texts = texts.join(edges, F.col("rid").eqNullSafe(F.col("e_rid")) & (F.col("th") == F.col("e_th"))).select("rid", "th", "text", "runs")
    windows = written(_window_hashes(edge_texts, window), "windows")
    again = windows.groupBy("h").agg(F.count("*").alias("times"), F.min("rid").alias("ref_id"), F.min_by("start", "rid").alias("ref_start")).where("times > 1").drop("times")
    again = written(again, "again")
    return whole.unionByName(windows.join(again, "h").select("rid", "th", "start", F.lit(1).alias("n"), "ref_id", "ref_start"))


def _factors(found: list[dict], window: int) -> list[tuple[int, int, object, int]]:
    """Greedy left-to-right parse of a document's matches: (start, words, reference id, reference start)."""
    out: list[list] = []
    for m in sorted(found, key=lambda m: (m["start"], -m["n"])):
        start, stop = m["start"], m["start"] + m["n"] + window - 1
        if out:
            last = out[-1]
            if start + window - 1 <= last[1] and m["ref_id"] == last[2] and m["ref_start"] - start == last[3] - last[0]:
                last[1] = max(last[1], stop)
                continue
        out.append([start, stop, m["ref_id"], m["ref_start"]])
    return [(a, b - a, r, s) for a, b, r, s in out]


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (rid, n_words, n_removed, kept_text, factors).

    ``factors`` lists (start, words, ref_id, ref_start) of the factors of at least ``window`` words that also
    start elsewhere (the first occurrence in id order is the reference of all, so it refers to itself).
    ``kept_text`` has the words outside every factor, joined by one space. Words are split at ASCII
    white space and compared as they are. Null and empty texts have no words and an empty kept_text;
    texts shorter than a window lose nothing. Repeated rows count as occurrences of each other, so
    their windows are removed from all of them. Null ids are allowed; other columns are not read.
    Passages are compared by 64-bit hashes of their word sequence.
    """
    texts = _rows(docs, id_col, text_col)
    found = matches(docs, texts, id_col, text_col, window, seed)
    spans = found.groupBy(F.col("rid").alias("s_rid"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("start", "n", "ref_id", "ref_start")).alias("found"))
    joined = texts.join(spans, F.col("rid").eqNullSafe(F.col("s_rid")) & (F.col("th") == F.col("s_th")), "left").select("rid", "text", "found")
    rid = docs.schema[id_col].dataType
    factor = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("ref_id", rid), T.StructField("ref_start", T.IntegerType())])
    schema = T.StructType([T.StructField("rid", rid), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", T.ArrayType(factor))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, found = batch.column(1), batch.column(2)
            step = max(1, min(256, batch.num_rows))
            for at in range(0, batch.num_rows, step):
                n_words, removed, kept_text, all_factors = [], [], [], []
                for i in range(at, min(at + step, batch.num_rows)):
                    words = (text[i].as_py() or "").encode().split()
                    factors = _factors(found[i].as_py(), window) if found[i].is_valid else []
                    gone = np.zeros(len(words) + 1, np.int32)
                    for a, n, _, _ in factors:
                        gone[a] += 1
                        gone[a + n] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    n_words.append(len(words))
                    removed.append(int(gone.sum()))
                    kept_text.append(b" ".join(w for w, g in zip(words, gone) if not g) if removed[-1] else b" ".join(words))
                    all_factors.append([dict(zip(("start", "words", "ref_id", "ref_start"), f)) for f in factors])
                end = at + len(n_words)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[at:end], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string()),
                    pa.array(all_factors, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_id", batch.schema.field(0).type), ("ref_start", pa.int32())])))], names=["rid", "n_words", "n_removed", "kept_text", "factors"])

    return joined.mapInArrow(run, schema)
