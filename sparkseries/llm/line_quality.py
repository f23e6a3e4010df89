"""Quality rules on lines that many documents of a host share.

Cross-document line frequency. Lines are normalised (words of letters, digits and characters beyond ASCII, in ASCII lower case, with
one sign for all words of digits alone) and hashed; for each host the different documents that hold a line are counted. Lines above the limit
are page furniture and are removed, and a document of which too little is left is rejected. Rules on the
text alone (length, repeated lines and passages, symbols) come from the same reading.

A document emits each of its lines once, exact copies of a text count as one document, and the count of (host, line) is dealt by
(host, line, text) first, so that neither a hot host nor a line of a third of all documents meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import written
from ._words import SPACE, Words, signed, slices

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
REPEAT = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _lines(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of all lines that are not empty."""
    breaks = np.flatnonzero(raw == 10)
    full = np.flatnonzero(np.diff(bounds))
    text = np.concatenate([full, np.searchsorted(bounds, breaks, "right") - 1])
    start = np.concatenate([bounds[full], breaks + 1])
    order = np.argsort(start, kind="stable")
    text, start = text[order], start[order]
    stop = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, start)], bounds[text + 1])
    some = stop > start
    return text[some], start[some], stop[some]


def _inside(w: Words, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of byte ranges that cut no word."""
    first = np.searchsorted(w.start, start)
    return first, np.searchsorted(w.start, stop) - first


def _normal(w: Words) -> Words:
    """The words of normalised lines."""
    plain = Words(_NORMAL[w.raw], w.bounds, False, _APART)
    digits = np.append(0, np.cumsum((plain.raw >= 48) & (plain.raw < 58)))
    plain.hash[digits[plain.stop] - digits[plain.start] == plain.stop - plain.start] = 0
    return plain


def _repeated(w: Words, size: int) -> np.ndarray:
    """Whether each word lies in a run of ``size`` words that its text holds more than once."""
    hashes, at = w.grams(size)
    _, same = np.unique(hashes, return_inverse=True)
    _, same, times = np.unique(w.text_of[at] * (same.max(initial=0) + 1) + same, return_inverse=True, return_counts=True)
    at = at[times[same] > 1]
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _measured(w: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The BASE counts of each text, and text, hash and words of its different normalised lines."""
    n = len(w.bounds) - 1
    within = lambda flags: np.diff(np.append(0, np.cumsum(flags))[w.bounds])
    letters = ~SPACE[w.raw] & ((w.raw & 0xC0) != 0x80)
    text, start, stop = _lines(w.raw, w.bounds)
    _, words = _inside(w, start, stop)
    text, start, stop, words = (x[words > 0] for x in (text, start, stop, words))
    _, same = np.unique(w.bytes_between(start, stop), return_inverse=True)
    distinct = np.unique(text * (same.max(initial=0) + 1) + same) // (same.max(initial=0) + 1)
    base = [np.diff(w.offsets), within(letters), within(_SYMBOL[w.raw]), np.bincount(text, minlength=n) - np.bincount(distinct, minlength=n), np.bincount(w.text_of[_repeated(w, REPEAT)], minlength=n)]
    plain = _normal(w)
    first, size = _inside(plain, start, stop)
    text, first, size, words = (x[size > 0] for x in (text, first, size, words))
    lines, same = np.unique(plain.ranges(plain.sums(), first, size), return_inverse=True)
    key, to = np.unique(text * max(len(lines), 1) + same, return_inverse=True)
    return base, key // max(len(lines), 1), lines[key % max(len(lines), 1)], np.bincount(to, words).astype(np.int64)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(rid, host, th = hash of the text, the BASE counts, lines = [(line, words)] of the different normalised lines) of each row."""
    rows = docs.select(F.col(id_col).alias("rid"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.col(text_col).cast("string").alias("text"))
    line = pa.struct([("line", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column(3)):
                base, text, lines, words = _measured(w)
                at = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                held = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(signed(lines)), pa.array(words)], fields=list(line)))
                yield pa.RecordBatch.from_arrays([batch.column(i)[a:b] for i in range(3)] + [pa.array(x.astype(np.int64)) for x in base] + [held], names=["rid", "host", "th", *BASE, "lines"])

    schema = T.StructType([rows.schema["rid"], T.StructField("host", T.StringType()), T.StructField("th", T.LongType()), *[T.StructField(c, T.LongType()) for c in BASE],
                           T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())])))])
    return rows.mapInArrow(run, schema)


def frequent_lines(measured: DataFrame, max_docs: int = 10, max_share: float = 0.0001) -> DataFrame:
    """(host, line, docs) of the lines in more than ``max_docs`` different documents of the host and more than ``max_share`` of them."""
    lines = measured.select("host", "th", F.explode("lines").alias("x")).select("host", "th", F.col("x.line").alias("line"))
    docs = lines.groupBy("host", "line").agg(F.countDistinct("th").alias("docs")).where(F.col("docs") > max_docs)
    hosts = measured.groupBy("host").agg(F.countDistinct("th").alias("host_docs"))
    return docs.join(hosts, "host").where(F.col("docs") > F.col("host_docs") * max_share).drop("host_docs")


def _audited(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, max_share: float, min_left: float) -> tuple[DataFrame, DataFrame]:
    """The verdict on each row, and its frequent lines by row."""
    measured = written(measure(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "lines")
    frequent = written(frequent_lines(measured, max_docs, max_share), "frequent")
    hits = (measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
            .join(frequent, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("gone_lines")))
    hits = written(hits, "hits")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = (measured.drop("lines").join(hits.select("row", "gone"), "row", "left")
               .select("row", "rid", "host", "th", *BASE, F.coalesce("gone", F.lit(0)).alias("removed_words"), base_failed.alias("base_failed"))
               .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.col("n_words") * min_left)))
    return verdict, hits


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, max_share: float = 0.0001, min_left: float = 0.3) -> DataFrame:
    """(rid, host, BASE counts, removed_words, base_failed, kept) of each row of ``docs``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in 8-word runs that the text repeats. ``kept``: not failed, and
    at least ``min_left`` of the words stand outside frequent lines. Words are runs outside ASCII white space, lines are split at ``\\n``.
    Null and empty texts have no words and fail; a text without line breaks is one line; lines of punctuation alone are never
    frequent; null hosts are one host of their own name ''. Copies of one text count as one document of a host, so repeated rows
    alone make no line frequent. Null and repeated ids are allowed, each row has its result; empty tables give empty
    results; other columns are not read. Lines and texts are compared by 64-bit hashes.
    """
    return _audited(docs, id_col, text_col, host_col, max_docs, max_share, min_left)[0].drop("row", "th")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, max_share: float = 0.0001, min_left: float = 0.3) -> DataFrame:
    """The rows that ``judge`` keeps, with their columns, and without the frequent lines in their text."""
    verdict, hits = _audited(docs, id_col, text_col, host_col, max_docs, max_share, min_left)
    gone = verdict.where("kept").join(hits.select("row", "gone_lines"), "row", "left").groupBy("rid", "host", "th").agg(F.first("gone_lines").alias("gone_lines"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("k_rid"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("k_host"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("k_th"))
    met = keyed.join(gone, F.col("k_rid").eqNullSafe(F.col("rid")) & (F.col("k_host") == F.col("host")) & (F.col("k_th") == F.col("th"))).select("doc", "gone_lines")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            text, gone = columns[place].cast(pa.string()), batch.column(1)
            columns[place] = pa.array([_without(t, g) for t, g in zip(text.to_pylist(), gone.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    schema = T.StructType([T.StructField(f"c{i}", T.StringType() if i == place else f.dataType) for i, f in enumerate(docs.schema.fields)])
    return met.mapInArrow(run, schema).toDF(*docs.columns)


def _without(text: str | None, gone: list[int] | None) -> str | None:
    """The text without the lines that have one of these hashes."""
    if text is None or not gone:
        return text
    lines, hashes = text.split("\n"), set(gone)
    (_, _, w), = slices(pa.array(["\n".join(lines)]))
    _, start, stop = _lines(w.raw, w.bounds)
    plain = _normal(w)
    first, size = _inside(plain, start, stop)
    found = signed(plain.ranges(plain.sums(), first, size))
    drop = iter((np.isin(found, list(hashes)) & (size > 0)).tolist())
    return "\n".join(x for x in lines if not (x and next(drop)))
