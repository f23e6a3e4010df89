"""Gaussian hidden-state models of many series, in time segments.

A segment's map is the product of its rows' matrices (moves times densities), scaled to sum 1. Applied from the start of a series on,
the maps give the forward messages in front of every segment, and from its end back the backward messages behind it. With both a
segment yields its rows' posteriors and its share of the sums of an EM step by itself, so no task holds a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import regimes
from . import scans, stats
from .scans import ROWS, Arrays, Segment, Step


class Messages(Step):
    """Forward messages, or backward ones, under a model; ``cols`` are the dimensions."""

    def __init__(self, model: dict, cols: Sequence[str], back: bool):
        self.model, self.cols, self.back, self.k = model, cols, back, len(model["start"])
        self.name, self.start = "behind" if back else "before", (1.0 / len(model["start"]),) * len(model["start"])

    def densities(self, s: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Densities of the rows under each state, scaled by their largest, and the logarithm of the scale."""
        if "densities" not in s.memo:
            log_b = regimes.log_density(np.nan_to_num(np.stack([s.x[c].astype(float) for c in self.cols], axis=1)), self.model["mean"], self.model["cov"])
            shift = log_b.max(axis=1, keepdims=True)
            s.memo["densities"] = np.exp(log_b - shift), shift
        return s.memo["densities"]

    def steps(self, s: Segment) -> np.ndarray:
        """The matrix of each row: moves times densities. The first row of a series starts from the model, whatever stands before it."""
        if "steps" not in s.memo:
            b = self.densities(s)[0]
            s.memo["steps"] = self.model["move"] * b[:, None, :]
            if not s.base:
                s.memo["steps"][0] = self.model["start"] * b[0]
        return s.memo["steps"]

    def reduce(self, s: Segment) -> Sequence[float]:
        if "product" not in s.memo:
            m = self.steps(s)
            while len(m) > 1:
                pairs = m[: len(m) // 2 * 2]
                m = np.concatenate([_scaled(pairs[::2] @ pairs[1::2]), m[len(pairs) :]])
            s.memo["product"] = _scaled(m)[0]
        return s.memo["product"].ravel()

    def apply(self, state: np.ndarray, found: np.ndarray) -> Sequence[float]:
        product = found.reshape(self.k, self.k)
        out = product @ state if self.back else state @ product
        return out / out.sum()

    def forward(self, s: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward messages of the rows, and their scales."""
        m = self.steps(s)
        a = s.state["before"] @ _running(m)
        a = a / a.sum(axis=1, keepdims=True)
        prior = np.concatenate([s.state["before"][None], a[:-1]])
        return a, (prior[:, None, :] @ m).sum(axis=(1, 2)) + 1e-300

    def smoothed(self, s: Segment) -> tuple[np.ndarray, np.ndarray, float]:
        """Posteriors of the rows, summed posteriors of the moves into them, and the log likelihood that they add."""
        b, shift = self.densities(s)
        a, scale = self.forward(s)
        last = s.state["behind"]
        # the messages behind a row: products of the rows after it, from the end on
        behind = _running(self.steps(s)[:0:-1].transpose(0, 2, 1)).transpose(0, 2, 1) @ last
        back = np.concatenate([(behind / behind.sum(axis=1, keepdims=True))[::-1], last[None]])
        post = a * back
        into = slice(0 if s.base else 1, None)
        prior = np.concatenate([s.state["before"][None], a[:-1]])[into]
        each = prior[:, :, None] * self.model["move"] * (b * back)[into][:, None, :]
        moves = (each / each.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return post / post.sum(axis=1, keepdims=True), moves, float(np.log(scale).sum() + shift.sum())


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / m.sum(axis=(1, 2), keepdims=True)


def _running(m: np.ndarray) -> np.ndarray:
    """Products of the matrices up to each one, scaled, by doubling the span that they cover."""
    m, span = _scaled(m), 1
    while span < len(m):
        m = np.concatenate([m[:span], _scaled(m[:-span] @ m[span:])])
        span *= 2
    return m


def fit_pooled_hmm(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], k: int = 2, rounds: int = 8, start_rows: int = 5000, rows: int = ROWS) -> dict:
    """One HMM for many series of at least two rows without nulls. Each round, segments send their sums, which Spark adds up; the driver holds only the
    model. The start comes from at most ``start_rows`` rows, taken in key order."""
    df = df.select(*dict.fromkeys([by, *order]), *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=list(cols))
    sample = np.array(df.select(*cols).orderBy(by, *order).limit(start_rows).toPandas(), float)  # bounded
    model, d = regimes.start_model(sample, k), len(cols)
    names, sizes = ["start", "move", "n", "x", "xx", "ll"], [k, k * k, k, k * d, k * d * d, 1]
    p = scans.packed(df, by, order, cols, rows)
    long = p.groupBy(F.col(by).alias("_of")).agg(F.sum("n").alias("_n")).where("_n > 1")
    p = stats.written_once(p.join(long, F.col(by).eqNullSafe(F.col("_of"))).drop("_of", "_n"))
    for _ in range(rounds):
        before, behind = Messages(model, cols, False), Messages(model, cols, True)

        def sums(s: Segment, step=before) -> Arrays:
            x = np.stack([s.x[c] for c in cols], axis=1)
            post, moves, ll = step.smoothed(s)
            first = np.zeros(k) if s.base else post[0]
            flat = np.concatenate([first, moves.ravel(), post.sum(axis=0), (post.T @ x).ravel(), np.einsum("ts,ti,tj->sij", post, x, x).ravel(), [ll]])
            return {"i": np.arange(len(flat)), "v": flat}

        found = scans.scan(p, by, order, cols, [[before, behind]], sums, "i int, v double", ready=True).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # a few numbers
        parts = np.split(np.array([r["v"] for r in found]), np.cumsum(sizes)[:-1])
        summed = dict(zip(names, (parts[0], parts[1].reshape(k, k), parts[2], parts[3].reshape(k, d), parts[4].reshape(k, d, d), parts[5])))
        model = regimes.maximise(summed) | {"ll": float(summed["ll"][0])}
    return model


def _posterior(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], idx: str, model: dict, rows: int, smooth: bool) -> DataFrame:
    before, behind = Messages(model, cols, False), Messages(model, cols, True)
    state = int(np.argmax(model["mean"][:, 0]))

    def replay(s: Segment) -> Arrays:
        post = before.smoothed(s)[0] if smooth else before.forward(s)[0]
        return {idx: s.x["i"].astype(np.int64), "growth": post[:, state]}

    named = df.select(*dict.fromkeys([by, *order]), *[F.col(c).cast("double").alias(c) for c in cols], F.col(idx).cast("long").alias("i"))
    return scans.scan(named, by, order, [*cols, "i"], [[before, behind] if smooth else [before]], replay, f"{idx} bigint, growth double", 0, rows)


def hmm_posterior(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], idx: str, model: dict, rows: int = ROWS) -> DataFrame:
    """Smoothed P(state with the largest mean of the first column) of every row (not causal); nulls count as 0."""
    return _posterior(df, by, order, cols, idx, model, rows, True)


def hmm_filter(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], idx: str, model: dict, rows: int = ROWS) -> DataFrame:
    """The same probability given the rows up to each one (causal)."""
    return _posterior(df, by, order, cols, idx, model, rows, False)
