"""Language identification by word-first backoff.

Training counts every word (maximal run of ASCII letters and characters beyond ASCII, lower-cased) for each language over all training texts,
and from the words' counts every character n-gram of the word between blanks. The model keeps all of them in
written tables. A word known to some language scores by its log relative frequency in each; an unknown word
falls back to the average over its n-grams of the greatest length of which any is known, down to single
characters; a language that lacks an entry takes a penalty below the rarest entry of that length.
A text scores the mean over its words; the language with the largest mean wins (ties: the smaller name).

The most frequent words are broadcast (at most ``head_words``) and summed where a text is read; a text's other words
are joined with the full table, and the distinct ones among them that no language knows meet the n-grams in
counted broadcast parts. The sizes bound memory only, never the result. Scores are multiples of 2**-24, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import discard, written
from ._words import NO_LETTER, U, Words, signed, slices

LETTER = regex.compile(r"\p{L}")
HEAD_WORDS, PART_GRAMS, ORDER, PENALTY, SHARPNESS, UNIT = 200_000, 500_000, 5, 2.0, 4.0, float(1 << 24)
Table = tuple[np.ndarray, np.ndarray]  # sorted hashes and their rows of scores


@dataclass(frozen=True)
class Model:
    """Languages (sorted); all words as ``words(entry, n, s0, s1, ...)`` and n-grams as ``grams(len, h, s0, s1, ...)``,
    with a score for each language (None without languages)."""

    languages: tuple[str, ...]
    words: DataFrame | None
    grams: DataFrame | None
    order: int

    @property
    def columns(self) -> list[str]:
        return [f"s{j}" for j in range(len(self.languages))]


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)


def word_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n) over all rows with a language, counted by slices before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for a, b, w in slices(_lowered(batch.column(1)), max_bytes=4 << 20, apart=NO_LETTER):
                lang = code[a:b][w.text_of]
                order = np.lexsort((w.hash, lang))
                h, g = w.hash[order], lang[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, int)
                raw, at = w.raw.tobytes(), order[first]
                yield pa.RecordBatch.from_arrays([
                    pa.array(langs[g[first]].astype(str), pa.string()), pa.array([raw[x:y] for x, y in zip(w.start[at].tolist(), w.stop[at].tolist())], pa.binary()).cast(pa.string()),
                    pa.array(np.diff(np.append(first, len(h))), pa.int64())], names=["lang", "word", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """(lang, len, h, n) of all n-grams of ``words(lang, word, n)`` between blanks, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            times = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, w in slices(batch.column(1), apart=NO_LETTER):
                for length in range(1, order + 1):
                    word, h = _grams(w, *_characters(w), length)
                    if not len(word):
                        continue
                    lang, n = code[a:b][w.text_of[word]], times[a:b][w.text_of[word]]
                    rank = np.lexsort((h, lang))
                    h, lang, n = h[rank], lang[rank], n[rank]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])))
                    yield pa.RecordBatch.from_arrays([pa.array(langs[lang[first]].astype(str), pa.string()), pa.array(np.full(len(first), length, np.int32)), pa.array(signed(h[first])), pa.array(np.add.reduceat(n, first))], names=["lang", "len", "h", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, len int, h bigint, n bigint").groupBy("lang", "len", "h").agg(F.sum("n").alias("n"))


def _exact(score: Column) -> Column:
    return F.rint(score * UNIT) / UNIT


def _scored(counts: DataFrame, by: list[str], languages: tuple[str, ...]) -> DataFrame:
    """Log relative frequencies by language (among entries of one ``len``) of all entries, with ``n`` over all languages."""
    sums = counts.groupBy("len", "lang").agg(F.sum("n").alias("total"), F.min("n").alias("least")).collect()  # a row for each language and length
    lengths = sorted({r["len"] for r in sums})
    floor = F.lit(None).cast("double")
    for length in lengths:
        floor = F.when(F.col("len") == length, float(min(np.log(r["least"] / r["total"]) for r in sums if r["len"] == length)) - PENALTY).otherwise(floor)
    own = []
    for j, lang in enumerate(languages):
        total = F.lit(None).cast("double")
        for r in (r for r in sums if r["lang"] == lang):
            total = F.when(F.col("len") == r["len"], float(r["total"])).otherwise(total)
        own.append(F.max(F.when(F.col("lang") == lang, F.log(F.col("n") / total))).alias(f"s{j}"))
    wide = counts.groupBy("len", *by).agg(F.sum("n").alias("n"), *own)
    return wide.select("len", *by, "n", *[_exact(F.coalesce(F.col(f"s{j}"), floor)).alias(f"s{j}") for j in range(len(languages))])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> Model:
    """The model from all rows with a language. Null and empty texts add nothing; without any word in
    any language the model has no languages and everything is ``und``."""
    counts = written(word_counts(docs, lang_col, text_col), "words")
    languages = tuple(sorted(r["lang"] for r in counts.select("lang").distinct().collect()))  # a row for each language
    if not languages:
        return Model((), None, None, order)
    grams = written(gram_counts(counts, order), "grams")
    words = written(_scored(counts.withColumn("len", F.lit(0)).withColumnRenamed("word", "entry"), ["entry"], languages).drop("len"), "scored_words")
    scored = written(_scored(grams, ["h"], languages).drop("n"), "scored_grams")
    discard(counts)
    discard(grams)
    return Model(languages, words, scored, order)


def _hashes(w: Words, start: np.ndarray, stop: np.ndarray, lead: np.ndarray | bool, trail: np.ndarray | bool) -> np.ndarray:
    """Hashes of byte ranges with flags for a blank before and behind."""
    return w.bytes_between(start, stop) ^ (np.asarray(lead).astype(U) * U(0x9FB21C651E98DF25)) ^ (np.asarray(trail).astype(U) * U(0xD6E8FEB86659FD93))


def _table(hashes: np.ndarray, scores: list[np.ndarray]) -> Table:
    rank = np.argsort(hashes)
    return hashes[rank], np.stack(scores, axis=1)[rank]


def _find(table: Table, h: np.ndarray) -> np.ndarray:
    """Row of each hash, -1 if it is not in the table."""
    known, _ = table
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _characters(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte of each character (and the end); first character and size in characters of the words."""
    begins = (w.raw & 0xC0) != 0x80
    number = np.cumsum(begins) - 1
    first = number[w.start]
    return np.append(np.flatnonzero(begins), len(w.raw)), first, number[w.stop - 1] - first + 1


def _grams(w: Words, chars: np.ndarray, first: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all n-grams of words between blanks; ``first`` and ``size`` are in characters."""
    words, hashes = [], []
    for lead, trail in ((0, 0), (1, 0), (0, 1), (1, 1)):
        m = n - lead - trail
        fits = np.flatnonzero((size == m) if lead and trail else (size >= m)) if m > 0 else np.zeros(0, int)
        times = size[fits] - m + 1 if not (lead or trail) else np.ones(len(fits), int)
        word = np.repeat(fits, times)
        step = np.arange(len(word)) - np.repeat(np.cumsum(times) - times, times)
        at = first[word] + (step if not (lead or trail) else size[word] - m if trail else 0)
        words.append(word)
        hashes.append(_hashes(w, chars[at], chars[at + m], bool(lead), bool(trail)))
    return np.concatenate(words), np.concatenate(hashes)


def _head(model: Model, head_words: int) -> Table:
    """The most frequent words, at most ``head_words``: whole classes of frequency from the top."""
    band = F.floor(F.log2("n") * 8).cast("int")
    low, held = None, 0
    for r in sorted(model.words.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):  # some hundred classes
        held += r["count"]
        if held > head_words:
            break
        low = r["band"]
    top = model.words.where(F.lit(False) if low is None else band >= low).select("entry", *model.columns).toArrow()  # at most head_words
    words = top.column("entry").combine_chunks()
    hashes = [w.hash for _, _, w in slices(words, apart=NO_LETTER)]  # every entry is one word
    return _table(np.concatenate(hashes) if hashes else np.zeros(0, U), [top.column(c).to_numpy() for c in model.columns])


def read(texts: pa.Array, head: Table, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(first row, end row, number of words that begin with an ASCII letter, number and summed scores of the words in ``head``, lists of the other words and of their counts) of slices."""
    for a, b, w in slices(texts, apart=NO_LETTER):
        rows = b - a
        _, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
        found = _find(head, w.hash[at])[which]
        hit = found >= 0
        n = np.bincount(w.text_of[hit], minlength=rows)
        total = np.stack([np.bincount(w.text_of[hit], weights=head[1][found[hit], j], minlength=rows) for j in range(k)], axis=1).astype(float)
        left = np.flatnonzero(~hit)
        left = left[np.lexsort((which[left], w.text_of[left]))]
        doc, word = w.text_of[left], which[left]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))) if len(left) else np.zeros(0, int)
        raw, times = w.raw.tobytes(), np.diff(np.append(first, len(left)))
        ends = pa.array(np.searchsorted(doc[first], np.arange(rows + 1)), pa.int32())
        entries = pa.array([raw[x:y] for x, y in zip(w.start[left[first]].tolist(), w.stop[left[first]].tolist())], pa.binary()).cast(pa.string())
        ascii_letters = np.bincount(w.text_of, weights=w.raw[w.start] < 128, minlength=rows)
        yield a, b, ascii_letters, n, total, pa.ListArray.from_arrays(ends, entries), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def _gram_parts(model: Model, part_grams: int) -> Iterator:
    """The n-grams as broadcasts of bounded size, dealt to parts by hash: for each length a table."""
    n = max(1, ceil(model.grams.count() / part_grams))
    for p in range(n):
        part = model.grams.where(F.pmod(F.xxhash64("h"), F.lit(n)) == p).toArrow()  # about part_grams
        length, h = part.column("len").to_numpy(), part.column("h").to_numpy().astype(np.int64).view(U)
        scores = [part.column(c).to_numpy() for c in model.columns]
        yield model.grams.sparkSession.sparkContext.broadcast([_table(h[length == x], [s[length == x] for s in scores]) for x in range(1, model.order + 1)])


def backed_off(words: DataFrame, model: Model, part_grams: int) -> DataFrame:
    """(entry, s0, s1, ...) of the distinct ``words(entry)`` of which some n-gram is known."""
    spread = ", ".join(f"{c} double" for c in model.columns)
    out = None
    for held in _gram_parts(model, part_grams):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, w in slices(batch.column(0), apart=NO_LETTER):  # every entry is one word
                    chars, first, size = _characters(w)
                    left = np.arange(b - a)
                    for length in range(len(held.value), 0, -1):  # a part knows of lengths below its greatest nothing that counts
                        table = held.value[length - 1]
                        word, h = _grams(w, chars, first[left], size[left], length)
                        found = _find(table, h)
                        word, found = word[found >= 0], found[found >= 0]
                        times = np.bincount(word, minlength=len(left))
                        got = np.flatnonzero(times)
                        sums = [np.bincount(word, weights=table[1][found, j], minlength=len(left))[got].astype(float) for j in range(table[1].shape[1])]
                        yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(left[got])), pa.array(np.full(len(got), length, np.int32)), pa.array(times[got].astype(np.int64)), *map(pa.array, sums)], names=["entry", "len", "times", *[f"s{j}" for j in range(len(sums))]])
                        left = left[times == 0]

        found = words.mapInArrow(run, f"entry string, len int, times bigint, {spread}")
        out = found if out is None else out.unionByName(found)
    own = out.groupBy("entry", "len").agg(F.sum("times").alias("times"), *[F.sum(c).alias(c) for c in model.columns])
    best = own.groupBy("entry").agg(F.max_by(F.struct("times", *model.columns), "len").alias("best"))
    return best.select("entry", *[_exact(F.col("best")[c] / F.col("best.times")).alias(c) for c in model.columns])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, part_grams: int = PART_GRAMS) -> DataFrame:
    """(rid, lang_pred, score) for every row; score is the winner's share of exp(SHARPNESS * mean score). Null, empty
    and letterless texts are ``und`` with score 0; a text with letters of which the model knows none gets the first
    language with an even score. Repeated rows and null ids are kept; no other column is read.
    """
    rid = F.col(id_col).alias("rid")
    if not model.languages:
        return docs.select(rid, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    k, columns = len(model.languages), model.columns
    held = docs.sparkSession.sparkContext.broadcast(_head(model, head_words))
    schema = T.StructType([T.StructField("rid", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("letters", T.BooleanType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns], T.StructField("entries", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lowered(batch.column(2))
            for a, b, ascii_letters, n, total, entries, times in read(texts, held.value, k):
                letters = ascii_letters > 0
                for i in np.flatnonzero(~letters):  # bytes above 127 need not be letters
                    letters[i] = LETTER.search(texts[a + int(i)].as_py()) is not None
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(letters), pa.array(n.astype(np.int64)), *[pa.array(total[:, j]) for j in range(k)], entries, times], names=schema.names)

    rows = written(docs.select(rid, F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema), "read")
    rest = rows.select("row", F.explode(F.arrays_zip("entries", "times")).alias("e")).select("row", F.col("e.entries").alias("entry"), F.col("e.times").alias("times"))
    distinct = written(rest.select("entry").distinct(), "rest")
    known = model.words.select("entry", *columns)
    scored = written(distinct.join(known, "entry").unionByName(backed_off(distinct.join(known, "entry", "left_anti"), model, part_grams)), "rest_scored")
    sums = rest.join(scored, "entry").groupBy("row").agg(F.sum("times").alias("m"), *[F.sum(F.col("times") * F.col(c)).alias(f"t{j}") for j, c in enumerate(columns)])
    both = rows.drop("entries", "times").join(sums, "row", "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0)))
    mean = both.select("rid", "letters", F.array(*[(F.col(c) + F.coalesce(f"t{j}", F.lit(0.0))) / F.greatest("n", F.lit(1)) for j, c in enumerate(columns)]).alias("mean"))
    mean = mean.withColumn("near", F.transform("mean", lambda x: F.round(x, 9))).withColumn("best", F.array_position("near", F.array_max("near")).cast("int"))
    share = 1 / F.aggregate("mean", F.lit(0.0), lambda s, x: s + F.exp(SHARPNESS * (x - F.element_at("mean", F.col("best")))))
    names = F.array(*map(F.lit, model.languages))
    return mean.select("rid", F.when(F.col("letters"), F.element_at(names, F.col("best"))).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))
