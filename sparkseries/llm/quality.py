"""Quality classifier: a sparse ensemble of rules over text statistics.

One pass computes a row of statistics for every whole text. On a bounded sample of labelled rows a random
forest of shallow trees is grown; every path from a root to an inner node or leaf is a conjunctive rule. A
lasso logistic regression over rules keeps few of them, and the kept rules are compiled into one Spark column
expression over the statistics, which scores all rows without Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import written
from ._words import SPACE, Words, slices

STATISTICS = ("log_words", "word_bytes", "long_words", "upper", "digit", "symbol", "other_byte", "stops", "lines", "line_words", "distinct", "top_word", "repeat_next", "repeat_5", "wordless", "ends_symbol", "mean_stop_gap", "upper_words")
MAX_FIT_ROWS, TREES, DEPTH, LASSO, SEED = 20_000, 24, 3, 0.001, 7
_kind = np.zeros(256, np.uint8)  # 1 letter, 2 upper, 3 digit, 4 space, 5 symbol
_kind[[*range(97, 123), *range(128, 256)]] = 1
_kind[[*range(65, 91)]] = 2
_kind[[*range(48, 58)]] = 3
_kind[SPACE] = 4
_kind[(_kind == 0)] = 5
_kind[:9] = 0
_mild = np.frombuffer(b".,;:'\"!?()-", np.uint8)


def describe(w: Words, rows: int) -> np.ndarray:
    """(rows, statistics) of a slice; empty texts have zeros."""
    out = np.zeros((rows, len(STATISTICS)))
    n, size = np.diff(w.offsets), np.diff(w.bounds)
    words, chars = np.maximum(n, 1), np.maximum(size, 1)

    def by_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1)
        np.cumsum(x, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    kind = _kind[w.raw]
    length = w.stop - w.start
    solid = np.maximum(by_text(length, w.offsets), 1)
    harsh = (kind == 5) & ~np.isin(w.raw, _mild)
    last = w.raw[w.stop - 1] if len(w.stop) else w.raw[:0]
    stops = by_text(last == 46, w.offsets)
    newline = by_text(w.raw == 10, w.bounds)
    letters = np.zeros(len(w.raw) + 1)
    np.cumsum((kind == 1) | (kind == 2), out=letters[1:])
    own = letters[w.stop] - letters[w.start]
    upper = np.zeros(len(w.raw) + 1)
    np.cumsum(kind == 2, out=upper[1:])
    caps = (upper[w.stop] - upper[w.start] == own) & (own > 1)
    order = np.lexsort((w.hash, w.text_of))
    h, t = w.hash[order], w.text_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, t[first], times)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text_of[1:] == w.text_of[:-1])
    g, at = w.grams(5)
    order = np.lexsort((g, w.text_of[at]))
    again = np.zeros(len(g), bool)
    again[1:] = (g[order][1:] == g[order][:-1]) & (w.text_of[at][order][1:] == w.text_of[at][order][:-1])
    repeats = np.bincount(w.text_of[at][order][again], minlength=rows)
    columns = (np.log1p(n), solid / words, by_text(length > 12, w.offsets) / words, by_text(kind == 2, w.bounds) / chars, by_text(kind == 3, w.bounds) / chars, by_text(harsh, w.bounds) / chars, by_text(w.raw > 127, w.bounds) / chars, stops / words,
               newline / words, n / (newline + 1), by_text(new, w.offsets) / words, most / words, by_text(same, w.offsets) / words, repeats / words, by_text(own == 0, w.offsets) / words, by_text(np.isin(last, _mild, invert=True) & (_kind[last] == 5), w.offsets) / words, n / (stops + 1), by_text(caps, w.offsets) / words)
    for i, c in enumerate(columns):
        out[:, i] = np.where(n > 0, c, 0)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, one double for each of STATISTICS) of every whole text."""
    schema = T.StructType([T.StructField("rid", docs.schema[id_col].dataType), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column(1)):
                found = describe(w, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names=["rid", *STATISTICS])

    return docs.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


Rule = tuple[tuple[str, str, float], ...]  # conditions (statistic, "<=" or ">", value)


def tree_rules(debug: str) -> list[Rule]:
    """All paths of a tree in MLlib's debug text, as rules."""
    out: list[Rule] = []
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3], float(m[4])))]
            out.append(tuple(sorted(p[1] for p in path)))
    return out


def compile_rule(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, value in rule:
        out = out & (F.col(name) <= value if op == "<=" else F.col(name) > value)
    return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """P(label 1) as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(compile_rule(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """Fit on at most ``max_fit_rows`` labelled rows, taken in the order of a hash of their id.

    Rows of ``labels`` without a label or without a text row do not count. With labels of one kind only (or
    none) the model is a constant: 1, 0 or 0.5. Where no statistic splits the labelled rows (few rows, equal texts) no tree has a
    rule, and the model is the constant share of label 1.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("double").alias("label"))
    joined = stats.join(known, F.col("rid") == F.col("_id")).orderBy(F.xxhash64("rid"), "rid").limit(max_fit_rows)
    sample = written(joined.select(*STATISTICS, "label"), "sample").coalesce(1)  # bounded by max_fit_rows
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Model((), (), {0: 0.0, 1: 40.0 * (1 if kinds and kinds[0] else -1)}[len(kinds)])
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(sample).select("x", "label", *STATISTICS)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=10, featureSubsetStrategy="onethird", seed=SEED).fit(data)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString)))
    if not rules:
        ones, n = data.agg(F.sum("label"), F.count("label")).first()
        return Model((), (), math.log(ones / (n - ones)))
    fired = data.select("label", F.array(*[compile_rule(r).cast("double") for r in rules]).alias("r"))
    from pyspark.ml.functions import array_to_vector

    lassoed = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(fired.select("label", array_to_vector("r").alias("x")))
    kept = [(r, float(c)) for r, c in zip(rules, lassoed.coefficients.toArray()) if abs(c) > 1e-9]
    return Model(tuple(r for r, _ in kept), tuple(c for _, c in kept), float(lassoed.intercept))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(rid, score) for every row of ``statistics``: empty and null texts are scored from zeros, repeated
    rows and null ids are kept."""
    return stats.select("rid", model.score().alias("score"))
