"""How far the sources of a language diverge in the terms they use, and the terms that set a source apart.

Late string materialization. The counting shuffle carries 64-bit digests of terms, never their text: tasks sum
the occurrences and documents of each (language, source, digest) first, one exchange by (language, digest)
then serves both the sums and the document limit of a language. The texts of the digests that stay come from a
second reading: the smallest and the largest string of a digest. Where these differ, terms share the digest;
only such digests are counted again by their text and split. Values are compared by digest, and
text is joined to the few terms that the result names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._state import counted, written
from ._words import LOWER, NO_LETTER, U, Words, signed, slices

SCALE = 1_000_000_000
TERMS, CELLS = 1 << 10, 1 << 22  # of a block: terms, and terms x sources
_HELD = 1 << 20  # entries of a task before it hands them on


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


class _Codes:
    """Small integers for tuples of strings, within a task."""

    def __init__(self) -> None:
        self.seen: dict[tuple, int] = {}

    def of(self, *columns: pa.Array) -> np.ndarray:
        return np.array([self.seen.setdefault(x, len(self.seen)) for x in zip(*[c.to_pylist() for c in columns])], np.int64)

    def columns(self, codes: np.ndarray) -> list[pa.Array]:
        return [pa.array(list(x), pa.string()).take(pa.array(codes)) for x in zip(*self.seen)]


def _pairs(major: np.ndarray, minor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as ``major * width + minor``, and the place of each input in them."""
    return np.unique(major * width + minor, return_inverse=True)


def _digest(w: Words, bits: int) -> np.ndarray:
    return w.hash & U((1 << bits) - 1)


def digest_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, n occurrences, docs) summed within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size = _Codes(), [], 0

        def summed() -> pa.RecordBatch:
            code, digest, n, docs = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((digest, code))
            code, digest = code[order], digest[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (digest[1:] != digest[:-1])))
            return pa.RecordBatch.from_arrays([*codes.columns(code[first]), pa.array(signed(digest[first])), pa.array(np.add.reduceat(n[order], first)), pa.array(np.add.reduceat(docs[order], first))], names=["lang", "source", "digest", "n", "docs"])

        for batch in batches:
            group = codes.of(batch.column(0), batch.column(1))
            for a, b, w in slices(batch.column(2), lower=True, apart=NO_LETTER):
                if not len(w.start):
                    continue
                terms, term = np.unique(_digest(w, bits), return_inverse=True)
                per_text, at = _pairs(w.text_of, term, len(terms))
                per_group, to = _pairs(group[a:b][per_text // len(terms)], per_text % len(terms), len(terms))
                n = np.bincount(to, np.bincount(at)).astype(np.int64)
                held.append((per_group // len(terms), terms[per_group % len(terms)], n, np.bincount(to)))
                size += len(n)
                if size >= _HELD:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return rows.mapInArrow(run, "lang string, source string, digest long, n long, docs long")


def _spellings(w: Words, digest: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word with each word's digest, and whether the two are equal byte by byte."""
    _, first, term = np.unique(digest, return_index=True, return_inverse=True)
    size, like = w.stop - w.start, first[term]
    same = size == size[like]
    at = np.flatnonzero(same)
    ends = np.cumsum(size[at])
    here = np.arange(ends[-1]) + np.repeat(w.start[at] - (ends - size[at]), size[at])
    there = here + np.repeat(w.start[like[at]] - w.start[at], size[at])
    same[at] = np.logical_and.reduceat(text[here] == text[there], ends - size[at])
    return like, same


def term_counts(rows: DataFrame, bits: int, by_source: bool) -> DataFrame:
    """(lang, source, digest, term, n, docs) of each task; without ``by_source`` only the distinct (lang, digest, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = _Codes(), {}

        def handed() -> pa.RecordBatch:
            keys = np.array([k[0] for k in seen], np.int64)
            columns = codes.columns(keys)
            digest, term = pa.array(np.array([k[1] for k in seen], np.int64)), pa.array([k[2] for k in seen], pa.binary()).cast(pa.string())
            if not by_source:
                return pa.RecordBatch.from_arrays([columns[0], digest, term], names=["lang", "digest", "term"])
            n, docs = np.array(list(seen.values()), np.int64).T
            return pa.RecordBatch.from_arrays([*columns, digest, term, pa.array(n), pa.array(docs)], names=["lang", "source", "digest", "term", "n", "docs"])

        for batch in batches:
            group = codes.of(batch.column(0), batch.column(1)) if by_source else codes.of(batch.column(0))
            for a, b, w in slices(batch.column(2), lower=True, apart=NO_LETTER):
                if not len(w.start):
                    continue
                digest, text = _digest(w, bits), LOWER[w.raw]
                spelled, same = _spellings(w, digest, text)
                raw = text.tobytes()
                odd: dict[tuple, int] = {}
                for i in np.flatnonzero(~same):  # words that share a digest with another word of this slice
                    spelled[i] = odd.setdefault((digest[i], raw[w.start[i] : w.stop[i]]), i)
                per_text, at = _pairs(w.text_of, spelled, len(digest))
                per_group, to = _pairs(group[a:b][per_text // len(digest)], per_text % len(digest), len(digest))
                word, code = per_group % len(digest), per_group // len(digest)
                n, docs = np.bincount(to, np.bincount(at)).astype(np.int64).tolist(), np.bincount(to).tolist()
                for c, d, i, j, x, y in zip(code.tolist(), signed(digest[word]).tolist(), w.start[word].tolist(), w.stop[word].tolist(), n, docs):
                    key = (c, d, raw[i:j])
                    have = seen.get(key)
                    seen[key] = (x, y) if have is None else (have[0] + x, have[1] + y)
                if len(seen) >= _HELD:
                    yield handed()
                    seen.clear()
        if seen:
            yield handed()

    return rows.mapInArrow(run, "lang string, source string, digest long, term string, n long, docs long" if by_source else "lang string, digest long, term string")


def _frequent(counts: DataFrame, term: list[str], min_docs: int) -> DataFrame:
    """Counts of the terms in at least ``min_docs`` documents of their language, with the language's own count."""
    w = Window.partitionBy("lang", *term)
    sums = counts.groupBy("lang", *term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumns({"total": F.sum("n").over(w), "in_docs": F.sum("docs").over(w), "one": (F.min("source").over(w) == F.col("source")).cast("int")}).where(F.col("in_docs") >= min_docs).drop("docs", "in_docs")


def kept_terms(rows: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, split, n, total, one) of the kept terms that occur in a source, and (lang, digest, split, term).

    ``one`` is 1 in one row of each term; ``split`` tells terms with one digest apart and is 0 for all others.
    """
    kept = written(_frequent(digest_counts(rows, bits).repartition("lang", "digest"), ["digest"], min_docs), "digests").withColumn("split", F.lit(0))
    known = term_counts(rows, bits, False).join(kept.where("one = 1").select("lang", "digest"), ["lang", "digest"], "left_semi")
    ends, seen = counted(known.groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "spellings", clashes=F.sum((F.col("term") != F.col("last")).cast("int")))
    names = ends.select("lang", "digest", F.lit(0).alias("split"), "term")
    if not seen["clashes"]:
        return kept, names
    clash = ends.where("term <> last").select("lang", "digest")
    parts = _frequent(term_counts(rows, bits, True).join(clash, ["lang", "digest"], "left_semi"), ["digest", "term"], min_docs)
    parts = written(parts.withColumn("split", F.dense_rank().over(Window.partitionBy("lang", "digest").orderBy("term"))), "split")
    return (kept.join(clash, ["lang", "digest"], "left_anti").unionByName(parts.drop("term")),
            names.join(clash, ["lang", "digest"], "left_anti").unionByName(parts.where("one = 1").select("lang", "digest", "split", "term")))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact; null without terms."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(19, 0))) div CAST(nullif({total} + 2 * {terms}, 0) AS DECIMAL(19, 0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value), source < item: the gaps of two sources summed over all kept terms. Terms are dealt to blocks of
    about ``TERMS`` terms, less where that is more than ``CELLS`` terms x sources; a block has the share of absent terms of each source beside its own rows."""
    blocks = groups.where("terms > 0").groupBy("lang").agg(F.ceil(F.first("terms") * F.greatest(F.lit(1 / TERMS), F.count(F.lit(1)) / F.lit(CELLS))).cast("int").alias("blocks"))
    known = groups.join(blocks, "lang")
    left = (kept.join(known.select("lang", "source", "n_group", "terms", "blocks"), ["lang", "source"])
            .select("lang", F.pmod(F.xxhash64("digest", "split"), F.col("blocks")).cast("int").alias("block"), "source", "digest", "split", share("n", "n_group", "terms").alias("p")))
    right = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", share("0", "n_group", "terms").alias("p"))

    def run(own: pa.Table, absent: pa.Table) -> pa.Table:
        names, lang = absent["source"].to_pylist(), absent["lang"][0].as_py() if absent.num_rows else ""
        at = {s: i for i, s in enumerate(names)}
        source, target, value = [], [], []
        if own.num_rows:
            _, term = np.unique(np.stack([own["digest"].to_numpy(), own["split"].to_numpy()], axis=1), axis=0, return_inverse=True)
            p = np.repeat(absent["p"].to_numpy()[:, None], term.max() + 1, axis=1)
            p[[at[s] for s in own["source"].to_pylist()], term.ravel()] = own["p"].to_numpy()
            for i in range(len(names) - 1):
                q = p[i + 1 :]
                sums = ((p[i] - q) ** 2 // (p[i] + q)).sum(axis=1).tolist()
                for s, v in zip(names[i + 1 :], sums):
                    source.append(min(names[i], s))
                    target.append(max(names[i], s))
                    value.append(v)
        return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(target, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): the gap of each source to each other source of its language (part ``pair``, all
    ranks) and the terms that a source uses more than its language does (part ``term``, ``top`` ranks; ties by UTF-8).

    Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased; a language keeps those in at least
    ``min_docs`` of its rows. Null texts, languages and sources count as empty strings, which are a language and a source like
    others; texts without a term count as documents of a group without terms; repeated rows count
    each. A language without kept terms has pairs of value 0 and no terms; an only source has no pairs; an empty table gives an
    empty result. Other columns are not read. ``bits`` is the width of a digest (tests make it small, so that terms collide).
    Counts are exact up to the range of a long.
    """
    rows = _rows(docs, text_col, lang_col, source_col)
    kept, names = kept_terms(rows, min_docs, bits)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("one").alias("one"))
    per_lang = sums.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("one").alias("terms"))
    groups = written(rows.select("lang", "source").distinct().join(sums.drop("one"), ["lang", "source"], "left").join(per_lang, "lang", "left")
                     .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("n", "n_group"), ("n_lang", "n_lang"), ("terms", "terms"))]), "groups")
    both = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    found = written(_pair_sums(kept, groups), "pairs")
    found = found.unionByName(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.join(found, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    own = kept.join(groups, ["lang", "source"]).select("lang", "source", "digest", "split", share("n", "n_group", "terms").alias("p"), share("total", "n_lang", "terms").alias("q")).where("p > q")
    best = own.select("lang", "source", "digest", "split", gap("p", "q").alias("value")).withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top)
    named = best.join(names, ["lang", "digest", "split"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(named)
