"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Words are lower-cased (A-Z) and split at ASCII white space. The rolling hashes of all ``min_match``-word
runs of a document are joined with those of the benchmark items (the shared seeds). For each item that
the seeds could cover far enough, matches are tiled: seeds on one diagonal grow into maximal matches,
the longest match is marked, what it overlaps is cut back and offered again, until no match of
``min_match`` words is left. Tiles overlap neither in the document nor in the item, so moved passages count
and repeated ones count once. A document is contaminated by an item if tiles cover at least
``coverage`` of the item's words.

The benchmark is broadcast in parts of at most ``part_words`` words (counted before), one pass over the
documents for each part; a benchmark beyond that size takes more passes, not more memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._words import U, Words, slices

MIN_MATCH, COVERAGE, PART_WORDS, PAIRS = 5, 0.6, 2_000_000, 4_000_000


class Items:
    """The seeds and word hashes of one part of the benchmark."""

    def __init__(self, ids: list, texts: list[str], min_match: int, times: list[int] | None = None):
        seeds, item, pos, self.words, self.ids, self.times = [], [], [], [], ids, times or [1] * len(ids)
        for a, b, w in slices(pa.array(texts, pa.large_string()), lower=True, max_bytes=1 << 22):
            g, at = w.grams(min_match)
            seeds.append(g)
            item.append(w.text_of[at] + a)
            pos.append(at - w.offsets[w.text_of[at]])
            self.words += [w.hash[x:y] for x, y in zip(w.offsets, w.offsets[1:])]
        seeds, item, pos = (np.concatenate(x) if x else np.zeros(0, int) for x in (seeds, item, pos))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.pos = seeds[order].astype(U), item[order], pos[order]
        self.min_match = min_match


def tiles(i: np.ndarray, j: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the seed pairs (document word i, item word j): (i, j, words) of each tile."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i - j) != 0) | (np.diff(i) != 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(i))) + min_match - 1
    heap = [(-int(n), int(i[f]), int(j[f])) for f, n in zip(first, size)]
    heapq.heapify(heap)
    used_i, used_j, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + x not in used_i and b + x not in used_j for x in range(-n)]
        if all(free):
            out.append((a, b, -n))
            used_i.update(range(a, a - n))
            used_j.update(range(b, b - n))
            continue
        x = 0
        while x < -n:  # offer again what is not covered
            y = x
            while y < -n and free[y]:
                y += 1
            if y - x >= min_match:
                heapq.heappush(heap, (x - y, a + x, b + x))
            x = y + 1
    return sorted(out)


def found_in(texts: pa.Array, items: Items, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item index, tiles) of every text that an item contaminates."""
    k = items.min_match
    if not len(items.seeds):
        return
    for a, _, w in slices(texts, lower=True):
        g, at = w.grams(k)
        lo = np.searchsorted(items.seeds, g)
        hit = np.flatnonzero(items.seeds[np.minimum(lo, len(items.seeds) - 1)] == g)
        if not len(hit):
            continue
        lo, g, at = lo[hit], g[hit], at[hit]
        n = np.searchsorted(items.seeds, g, "right") - lo
        # texts are taken together while their pairs of seeds stay few; a seed that many items share is expanded for one text at a time
        ends = np.append(np.flatnonzero(np.diff(w.text_of[at])) + 1, len(at))
        total, x = np.append(0, np.cumsum(n)), 0
        while x < len(at):
            y = max(int(ends[np.searchsorted(ends, x, "right")]), int(ends[max(0, np.searchsorted(total[ends], total[x] + PAIRS, "right") - 1)]))
            for doc, item, got in _tiled(w, items, at[x:y], lo[x:y], n[x:y], coverage):
                yield doc + a, item, got
            x = y


def _tiled(w: Words, items: Items, at: np.ndarray, lo: np.ndarray, n: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(text of the slice, item index, tiles) from the seeds at words ``at``, whose n matches begin at ``lo`` in the items' seeds."""
    k = items.min_match
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    doc, item, j = w.text_of[at], items.item[which], items.pos[which]
    order = np.lexsort((at, item, doc))
    doc, item, j, at = doc[order], item[order], j[order], at[order]
    cut = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0)))
    for x, y in zip(cut, np.append(cut[1:], len(doc))):
        need = coverage * len(items.words[item[x]])
        reach = np.zeros(len(items.words[item[x]]) + 1, np.int64)
        starts = np.unique(j[x:y])
        np.add.at(reach, starts, 1)
        np.add.at(reach, starts + k, -1)
        if (np.cumsum(reach)[:-1] > 0).sum() >= need:
            got = tiles(at[x:y] - w.offsets[doc[x]], j[x:y], k)
            if sum(t[2] for t in got) >= need:
                yield int(doc[x]), int(item[x]), got


def _parts(items: DataFrame, id_col: str, text_col: str, min_match: int, part_words: int) -> Iterator:
    """The benchmark as broadcasts of bounded size; different items are dealt to parts by hash, repeated ones are held once with their number."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_words = rows.distinct().agg(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+"))).alias("n")).first()["n"] or 0
    n = max(1, ceil(n_words / part_words))
    for p in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == p).groupBy("id", "text").agg(F.count(F.lit(1)).cast("int").alias("times")).collect()  # about part_words words
        yield spark.sparkContext.broadcast(Items([r["id"] for r in part], [r["text"] for r in part], min_match, [r["times"] for r in part]))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """(rid, item_id, item_words, matched_words, coverage, tiles) for every row of ``docs`` and item that
    contaminates it.

    Null or empty texts match nothing; items of fewer than ``min_match`` words are no evidence and match
    nothing. Repeated rows of either table are reported as often as they occur. Ties between longest
    matches go to the earliest place in the document, then in the item. Null ids are allowed; columns
    other than the four named are not read. Empty tables give no rows.
    """
    rid, iid = docs.schema[id_col].dataType, items.schema[item_col].dataType
    tile = T.StructType([T.StructField("doc_start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("words", T.LongType())])
    schema = T.StructType([T.StructField("rid", rid), T.StructField("item_id", iid), T.StructField("item_words", T.LongType()), T.StructField("matched_words", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(tile))])
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    id_type, out = to_arrow_type(iid), None
    for held in _parts(items, id_col=item_col, text_col=item_text_col, min_match=min_match, part_words=part_words):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            part = held.value
            for batch in batches:
                got = [x for x in found_in(batch.column(1), part, coverage) for _ in range(part.times[x[1]])]
                size = [len(part.words[i]) for _, i, _ in got]
                hit = [sum(t[2] for t in ts) for _, _, ts in got]
                struct = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_start", "item_start", "words")]))
                yield pa.RecordBatch.from_pydict({
                    "rid": batch.column(0).take(pa.array([r for r, _, _ in got], pa.int64())), "item_id": pa.array([part.ids[i] for _, i, _ in got], id_type),
                    "item_words": pa.array(size, pa.int64()), "matched_words": pa.array(hit, pa.int64()), "coverage": pa.array([h / s for h, s in zip(hit, size)], pa.float64()),
                    "tiles": pa.array([[dict(zip(("doc_start", "item_start", "words"), t)) for t in ts] for _, _, ts in got], struct)})

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """Rows of ``docs`` that no item contaminates (all columns; no shuffle)."""
    for held in _parts(items, item_col, item_text_col, min_match, part_words):
        docs = docs.where(~_leaked(held, coverage)(F.col(text_col).cast("string")))
    return docs


def _leaked(held, coverage: float):
    @F.arrow_udf("boolean")
    def leaked(texts: pa.Array) -> pa.Array:
        hit = np.zeros(len(texts), bool)
        for row, _, _ in found_in(texts, held.value, coverage):
            hit[row] = True
        return pa.array(hit)

    return leaked
