"""Toxicity by weak supervision.

Voters. A lexicon is mined from the labelled rows of a bounded sample: whole words and word prefixes that stand
in at least two toxic texts and whose rate a word is higher there than in clean texts by ``MIN_Z`` standard errors.
A word counts for the strongest entry that it matches, and entries that keep too little evidence of their own
go; of the others those stay of which each finds toxic rows that few stronger ones find. No number limits them. An entry votes where it occurs more often than its rate in clean texts explains
(clearly, or by far); pattern voters look at how the hits lie (none, several kinds, density, hits close together, early).

Label model. Votes are generated by a hidden class. Each voter's rates in both classes, which say how accurate it is,
and its dependence on one other voter (a tree over the voters, by their mutual information given the class) are estimated by
expectation maximisation over labelled and unlabelled rows of the sample. A label is one more voter of estimated accuracy.

The settings below were chosen by cross-validation among learning rows.

Classifier. A ridge logistic regression over the hits is fitted to the posterior labels and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._state import written
from ._words import NO_LETTER, U, Words, signed, slices

LENGTHS = (0, 3, 4, 5, 6, 7)  # prefix lengths in bytes; 0 is the whole word
MAX_FIT_ROWS, MIN_DOCS, MIN_Z, NEAR, EARLY = 20_000, 2, 3.0, 4, 20
WEAK, STRONG = 3.0, 4.0  # deviations from the clean rate at which an entry votes
BLOCK = 2048  # rows of a matrix in the fits
THRESHOLD = 0.3  # a text counts as toxic from this score on, in op10 and in the pipeline
PATTERNS, CODES, TRUST, LEAST_GAIN, PRIOR = 5, 3, 0.05, 1.0, 20.0
Entry = tuple[int, int, float, float]  # prefix length, hash, standard errors, rate in clean texts


def _features(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hashes, word index) of all words and prefixes."""
    for n in LENGTHS:
        yield (n, *((w.hash, np.arange(len(w.hash))) if n == 0 else w.prefixes(n)))


def _tally(length: int, key: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    """(length, key, toxic texts, occurrences in toxic texts, in clean texts) of each key; ``toxic`` is by text."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bad = toxic[doc].astype(np.int64)
    seen = np.add.reduceat(bad, first)
    return np.full(len(first), length, np.int32), key[first], np.add.reduceat(bad * new, first), seen, np.diff(np.append(first, len(key))) - seen


COUNTED = "length int, h bigint, docs bigint, toxic bigint, clean bigint"


def entry_counts(docs: DataFrame) -> DataFrame:
    """COUNTED for every word and prefix of the labelled rows of ``docs(text, label)``; length -1 has all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for a, b, w in slices(batch.column(0), lower=True, max_bytes=8 << 20, apart=NO_LETTER):
                parts = [(n, signed(h), w.text_of[at]) for n, h, at in _features(w) if len(h)]
                for n, h, doc in [*parts, (-1, np.zeros(len(w.hash), np.int64), w.text_of)] if len(w.hash) else []:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tally(n, h, doc, label[a:b])], names=["length", "h", "docs", "toxic", "clean"])

    counted = docs.where("label >= 0").select("text", "label").mapInArrow(run, COUNTED)
    return counted.groupBy("length", "h").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")])


def deviation(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Standard errors by which the log rate a word in toxic texts exceeds that in clean texts."""
    ratio = F.log((toxic + 0.5) / F.lit(all_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(all_clean + 1.0))
    return ratio / F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicon(docs: DataFrame, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> list[Entry]:
    """All entries with enough evidence, first from all their occurrences, then from the words that no stronger entry takes."""
    counts = written(entry_counts(docs), "entries")
    total = counts.where("length = -1").select("toxic", "clean").first()
    if total is None:
        return []

    def strong(df: DataFrame) -> list[Entry]:
        rows = df.withColumn("z", deviation(F.col("toxic"), F.col("clean"), *total)).where((F.col("docs") >= min_docs) & (F.col("z") >= min_z))
        found = rows.select("length", "h", "z", ((F.col("clean") + 0.5) / (total[1] + 1.0)).alias("rate")).toArrow().to_pydict()  # entries of the bounded sample
        return sorted(zip(found["length"], found["h"], found["z"], found["rate"]), key=lambda e: (-e[2], *e[:2]))

    table = Lexicon(strong(counts.where("length >= 0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for a, b, w in slices(batch.column(0), lower=True, max_bytes=8 << 20, apart=NO_LETTER):
                word, entry = table.hits(w)
                if len(word):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tally(0, entry, w.text_of[word], label[a:b])], names=["length", "h", "docs", "toxic", "clean"])

    own = docs.where("label >= 0").select("text", "label").mapInArrow(run, COUNTED).groupBy("length", "h").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")])
    return [(*table.entries[i][:2], z, rate) for _, i, z, rate in strong(own)]


class Lexicon:
    """Vectorised look-up of entries (strongest first) in texts."""

    def __init__(self, entries: list[Entry]):
        self.entries, self.tables = entries, []
        self.rate = np.array([e[3] for e in entries])
        for n in LENGTHS:
            own = sorted((np.int64(e[1]).astype(U), i) for i, e in enumerate(entries) if e[0] == n)
            if own:
                self.tables.append((n, np.array([h for h, _ in own], U), np.array([i for _, i in own])))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, entry) of all words that match an entry: the strongest one."""
        best = np.full(len(w.hash), len(self.entries))
        for n, h, at in _features(w):
            for _, known, index in (t for t in self.tables if t[0] == n and len(h)):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[place] == h)
                best[at[hit]] = np.minimum(best[at[hit]], index[place[hit]])
        word = np.flatnonzero(best < len(self.entries))
        return word, best[word]

    def describe(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row, entry and count of each hit pair, statistics of the rows) of slices.

        The statistics are hits, words, hits close to the one before, early hits; all are 0 without hits.
        """
        for a, b, w in slices(texts, lower=True, apart=NO_LETTER):
            word, entry = self.hits(w)
            doc = w.text_of[word]
            pair, n = np.unique(doc * len(self.entries) + entry, return_counts=True) if len(word) else (np.zeros(0, int),) * 2
            close = np.append(False, (np.diff(word) <= NEAR) & (doc[1:] == doc[:-1])) if len(word) else np.zeros(0, bool)
            times = lambda which: np.bincount(doc[which], minlength=b - a)
            hits = np.bincount(doc, minlength=b - a)
            early = word - w.offsets[doc] < EARLY
            yield a, b, pair // max(1, len(self.entries)), pair % max(1, len(self.entries)), n, np.stack([hits, np.diff(w.offsets) * (hits > 0), times(close), times(early)], axis=1)


def excess(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Signed root of the Poisson deviance of counts (above 0) from their expectation."""
    out = np.sqrt(np.maximum(0, 2 * (count * np.log(count / expected) - count + expected)))
    return np.where(count > expected, out, 0)


def vote_codes(row: np.ndarray, entry: np.ndarray, count: np.ndarray, stats: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """0 abstains, 1 toxic, 2 toxic by far: of each hit pair."""
    z = excess(count, rate[entry] * stats[row, 1] + 1e-9)
    return (z >= WEAK).astype(np.int8) + ((z >= STRONG) & (count > 1))


def votes(rows: int, row: np.ndarray, entry: np.ndarray, count: np.ndarray, stats: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Codes of every entry voter (0 abstains, 1 toxic, 2 toxic by far) and pattern voter (0 abstains, 1 toxic, 2 clean)."""
    hits, words, close, early = stats.T
    out = np.zeros((rows, len(rate) + PATTERNS), np.int8)
    code = vote_codes(row, entry, count, stats, rate)
    out[row, entry] = code
    kinds, far = (np.bincount(row, weights=x, minlength=rows) for x in (np.ones(len(row)), code > 0))
    density = hits / np.maximum(words, 1)
    patterns = (np.where(hits == 0, 2, 0), np.where(far >= 2, 1, np.where(far == 0, 2, 0)), np.where(density > 0.01, 1, np.where(density < 0.002, 2, 0)), (close > 0) * 1, np.where(early > 0, 1, (kinds == 1) * 2))
    out[:, len(rate) :] = np.stack(patterns, axis=1)
    return out


def cover(row: np.ndarray, entry: np.ndarray, code: np.ndarray, entries: int, weight: np.ndarray, label: np.ndarray, least: float = LEAST_GAIN) -> list[int]:
    """Greedy choice of entry voters from the votes cast, by all votes of an entry or by those that are toxic by far: each adds the
    most toxic rows that few chosen ones cover, less twice the clean ones, until none adds ``least`` rows."""
    chosen, value = [], weight * np.select([label == 1, label == 0], [1.0, -2.0], 0.0)
    voter, row = np.concatenate([entry, entry[code == 2] + entries]), np.concatenate([row, row[code == 2]])
    order = np.argsort(voter, kind="stable")
    voter, row = voter[order], row[order]
    while len(voter):
        gain = np.bincount(voter, weights=value[row], minlength=2 * entries)
        gain[chosen] = -1
        best = int(np.argmax(gain))
        if gain[best] < least:
            break
        chosen.append(best)
        value[row[np.searchsorted(voter, best) : np.searchsorted(voter, best, "right")]] /= 2
    return sorted({c % entries for c in chosen})


def _joint(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of all pairs of codes: (voters * CODES, voters * CODES)."""
    out = np.zeros((v.shape[1] * CODES,) * 2)
    for at in range(0, len(v), BLOCK):
        one = (v[at : at + BLOCK, :, None] == np.arange(CODES)).reshape(len(v[at : at + BLOCK]), -1).astype(float)
        out += (one * weight[at : at + BLOCK, None]).T @ one
    return out


def correlation_tree(joint: list[np.ndarray], voters: int) -> np.ndarray:
    """Parent of each voter (itself: none) in the tree with the most mutual information given the class."""
    info, all_rows = np.zeros((voters, voters)), sum(j.trace() / voters for j in joint)
    for j in joint:
        n = j.trace() / voters
        p = j.reshape(voters, CODES, voters, CODES).transpose(0, 2, 1, 3) / max(n, 1e-12)
        own = np.einsum("iiab->ia", p)
        info += n / all_rows * np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / np.maximum(own[:, None, :, None] * own[None, :, None, :], 1e-300)), 0).sum(axis=(2, 3))
    parent, left = np.arange(voters), np.ones(voters, bool)
    left[0], best = False, np.where(np.arange(voters) > 0, info[0], -1)
    link = np.zeros(voters, int)
    while left.any():
        x = int(np.argmax(np.where(left, best, -1)))
        parent[x], left[x] = (link[x] if best[x] * all_rows > CODES**2 * np.log(all_rows + 1) else x), False  # an edge must pay for its parameters
        link, best = np.where(info[x] > best, x, link), np.maximum(best, info[x])
    return parent


def label_model(v: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int = 30, trust: float = TRUST, label_votes: bool = True) -> np.ndarray:
    """Posterior P(toxic) of rows of codes ``v`` that occur ``weight`` times.

    A label (1, 0; -1 unknown) gives the starting rates and is one more voter (unless ``label_votes`` is off): its accuracy in
    each class is estimated like that of the others. Rows without label count by the weight ``trust``. Without labels of both kinds all rows start from the
    share of voters that do not abstain.
    """
    voters, known, yes = v.shape[1], label >= 0, label == 1
    told = {0, 1} <= set(label.tolist())
    cast = (v == 1).sum(axis=1) - 0.5 * (v[:, -PATTERNS:] == 2).sum(axis=1)
    post = np.where(known, label, 0.0) if told else np.clip(0.1 + 0.2 * cast, 0.05, 0.95)
    used = weight * np.where(known, 1.0, trust if told else 1.0)
    parent, last = np.arange(voters), post
    for step in range(rounds):
        now = used * known if told and step == 0 else used
        joint = [_joint(v, now * x) for x in (post, 1 - post)]
        sums = [now @ post, now @ (1 - post)]
        if step <= 3 if told else step == 3:
            parent = correlation_tree(joint, voters)
        odds, rates = np.full(len(v), np.log((sums[0] + 1) / (sums[1] + 1))), []
        for j, n in zip(joint, sums):
            table = j.reshape(voters, CODES, voters, CODES)
            own = (np.einsum("iaia->ia", table) + 0.5) / (n + 0.5 * CODES)
            of_parent = table[parent, :, np.arange(voters), :]  # (voter, parent's code, code)
            rates.append(np.where((parent == np.arange(voters))[:, None, None], own[:, None, :], (of_parent + 2 * own[:, None, :]) / (of_parent.sum(axis=2, keepdims=True) + 2)))
        change = np.log(rates[0]) - np.log(rates[1])
        for j in range(voters):
            odds += change[j, v[:, parent[j]], v[:, j]]
        if told and label_votes:
            right = [((weight * x * z)[known].sum() + PRIOR - 1) / ((weight * x)[known].sum() + PRIOR) for x, z in ((post, yes), (1 - post, ~yes))]
            odds += np.where(known, np.where(yes, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1])), 0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if step > 3 and np.abs(post - last).max() < 1e-6:
            break
        last = post
    return post


def _inputs(rows: int, row: np.ndarray, entry: np.ndarray, count: np.ndarray, stats: np.ndarray, rate: np.ndarray) -> np.ndarray:
    hits, words, close, early = stats.T.astype(float)
    out = np.zeros((rows, len(rate) + 7))
    z = np.minimum(excess(count, rate[entry] * words[row] + 1e-9), 8)
    out[row, entry] = z / 4
    kinds, far = np.bincount(row, minlength=rows), np.bincount(row, weights=z, minlength=rows)
    out[:, len(rate) :] = np.stack([np.ones(rows), hits == 0, np.log1p(far), np.log1p(100 * hits / np.maximum(words, 1)), np.log1p(close), np.log1p(early), np.log1p(kinds)], axis=1)
    return out


def logistic(blocks, width: int, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression to soft labels (Newton steps over ``blocks()`` of (rows, inputs))."""
    w, penalty = np.zeros(width), np.full(width, ridge)
    penalty[-7] = 1e-6  # the constant
    for _ in range(rounds):
        hess, grad = np.diag(penalty + 1e-9), -penalty * w
        for rows, x in blocks():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess += (x * (p * (1 - p) * weight[rows])[:, None]).T @ x
            grad += x.T @ ((y[rows] - p) * weight[rows])
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    entries: tuple[Entry, ...]
    weights: np.ndarray

    def score(self, texts: pa.Array, lexicon: Lexicon | None = None) -> np.ndarray:
        lexicon, out = lexicon or Lexicon(list(self.entries)), np.zeros(len(texts))
        for a, b, row, entry, count, stats in lexicon.describe(texts):
            out[a:b] = 1 / (1 + np.exp(-np.clip(_inputs(b - a, row, entry, count, stats, lexicon.rate) @ self.weights, -30, 30)))
        return out


def described(texts: DataFrame, entries: list[Entry]) -> pa.Table:
    """(label, entry, count, stats, n): equal rows of hits of the sample with their number; all rows without hits
    of one label are one row, so only texts with hits of the bounded sample travel."""
    table = Lexicon(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, entry, count, stats in table.describe(batch.column(0)):
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (entry, count)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], *lists, pa.array(stats.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["label", "entry", "count", "stats"])

    rows = texts.select("text", "label").mapInArrow(run, "label int, entry array<int>, count array<int>, stats array<int>")
    return rows.groupBy("label", "entry", "count", "stats").agg(F.count("*").alias("n")).orderBy("label", "stats", "entry", "count").toArrow()


class Sample:
    """The rows of ``described`` as arrays, handed out in blocks."""

    def __init__(self, rows: pa.Table):
        self.label, self.weight = rows["label"].to_numpy().astype(int), rows["n"].to_numpy().astype(float)
        self.stats = rows["stats"].combine_chunks().flatten().to_numpy().reshape(-1, 4)
        self.entry, self.count = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("entry", "count"))
        self.ends = np.append(0, np.cumsum(rows["entry"].combine_chunks().value_lengths().to_numpy()))

    def blocks(self, make, rate: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, len(self.label), BLOCK):
            b = min(a + BLOCK, len(self.label))
            own = slice(self.ends[a], self.ends[b])
            yield slice(a, b), make(b - a, np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.entry[own], self.count[own], self.stats[a:b], rate)


def choose(entries: list[Entry], s: Sample) -> list[Entry]:
    """The entries that ``cover`` takes."""
    row, rate = np.repeat(np.arange(len(s.label)), np.diff(s.ends)), np.array([e[3] for e in entries])
    code = vote_codes(row, s.entry, s.count, s.stats, rate)
    cast = code > 0
    return [entries[i] for i in cover(row[cast], s.entry[cast], code[cast], len(entries), s.weight, s.label)]


def train(entries: list[Entry], s: Sample) -> Model:
    """Label model and classifier."""
    rate = np.array([e[3] for e in entries])
    post = label_model(np.concatenate([v for _, v in s.blocks(votes, rate)]), s.weight, s.label)
    return Model(tuple(entries), logistic(lambda: s.blocks(_inputs, rate), len(entries) + 7, post, s.weight))


def _share(rows: int, most: int) -> float:
    """Part of the ids whose hashes select at most about ``most`` of ``rows`` rows."""
    return 1.0 if rows <= most else 0.97 * most / rows


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_fit_rows: int) -> DataFrame:
    """(text, label) of about ``max_fit_rows`` labelled texts and as many unlabelled ones (label -1), by a hash of the id;
    equal texts with equal labels are one row."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    known = written(known, "labels")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)) / F.lit(float(1 << 20))
    told, quiet = _share(known.count(), max_fit_rows), _share(docs.count(), max_fit_rows)
    near = known.where(place("_id") < max(told, quiet))
    near = F.broadcast(near) if near.count() <= 4 * max_fit_rows else near
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("text")).where(F.col("rid").isNotNull() & (place("rid") < max(told, quiet)))
    label, at = F.coalesce("label", F.lit(-1)), place("rid")
    rows = rows.join(near, F.col("rid") == F.col("_id"), "left").where(((F.col("label").isNotNull()) & (at < told)) | (F.col("label").isNull() & (at < quiet)))
    return written(rows.select("text", label.alias("label")).groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text")).select("text", "label"), "sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS, min_z: float = MIN_Z) -> Model:
    """Fit on about ``max_fit_rows`` labelled rows at most, and as many unlabelled ones, chosen by a hash of their id.

    Rows without a label count as unlabelled, null texts as empty. Without any toxic evidence the model gives
    every text the share that the label model finds (0.5 without rows).
    """
    texts = sample(docs, labels, id_col, text_col, label_col, max_fit_rows)
    entries = lexicon(texts, min_z=min_z)
    if entries:
        entries = choose(entries, Sample(described(texts, entries)))
    rows = Sample(described(texts, entries))
    return train(entries, rows) if len(rows.label) else Model((), np.zeros(7))


def scorer(spark, model: Model):
    """A function from a text column to P(toxic)."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(list(held.value.entries))  # once a task
        for texts in batches:
            yield pa.array(held.value.score(texts, lexicon))

    return lambda text: toxic(text.cast("string"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, score) of every row: null and empty texts score like texts without a hit, repeated rows and null
    ids are kept, other columns are not read."""
    return docs.select(F.col(id_col).alias("rid"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (all columns) with a score below the threshold; a model without lexicon entries has no evidence against
    any text and rejects nothing."""
    if not model.entries:
        return docs
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < threshold)
