"""Kernels on Spark: one series of a key is one Arrow table in a task.

A key's whole series must fit in a task's memory (90 days of 5-minute bars are 2 MB); resample denser series
first. Row indicators, cumulative sums and signatures are in ``scans`` and pooled hidden-state models in ``hidden``, which cuts a series into segments. Grid sweeps loop over configurations inside the task, so bars are moved once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import dsp, paths, regimes, trades
from . import stats
from .hidden import fit_pooled_hmm, hmm_filter, hmm_posterior  # noqa: F401  in segments
from .scans import cusum, indicators, prefix_signatures, signatures  # noqa: F401  in segments

Arrays = dict[str, np.ndarray]
BLOCK, SMALL_BLOCK, FEW_BLOCKS, MOST_TASKS = 8192, 1024, 16, 4096  # paths of a block at most, and of one that is not cut further; blocks of a small table; tasks
PAIRS = 2**17  # pairs of a batch
EPISODE = "entry_idx int, exit_idx int, duration int, entry_value double, peak_value double, exit_value double, peak_return_pct double, exit_return_pct double, initial_roc double, observed boolean"
TRADE = "entry_idx int, exit_idx int, entry_value double, exit_value double, peak_value double, bars_held int, return_pct double, peak_return_pct double, exit_reason string"


def per_key(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], fn: Callable[[Arrays], Arrays | list[dict]], schema: str) -> DataFrame:
    """``fn`` on the ordered arrays of each key; its arrays or rows come back under ``by`` and ``schema``."""
    key = df.schema[by].dataType
    out_schema = T.StructType([T.StructField(by, key), *T._parse_datatype_string(f"struct<{schema}>").fields])
    names = out_schema.names[1:]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        arrays = {c: table[c].to_numpy(zero_copy_only=False) for c in cols}
        got = fn(arrays)
        columns = {n: [r[n] for r in got] for n in names} if isinstance(got, list) else got
        rows = len(next(iter(columns.values())))
        target = table.schema.field(by).type
        made = [pa.array([table[by][0].as_py()] * rows, target)] + [pa.array(columns[n]).cast(t) if not isinstance(columns[n], list) else pa.array(columns[n], t) for n, t in zip(names, arrow_types)]
        return pa.table(made, names=out_schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = [to_arrow_type(f.dataType) for f in out_schema.fields[1:]]
    return df.select(*dict.fromkeys([by, *order, *cols])).groupBy(by).applyInArrow(run, out_schema)


def many_keys(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], fn: Callable[[list[Arrays]], list[Arrays]], schema: str, rows: int = 2**16, nulls_last: bool = False) -> DataFrame:
    """``fn`` on the ordered arrays of about ``rows`` rows' keys at a time (at least one key), for kernels that step through many series at once and for short
    series, where a call for each key costs more than its work. ``fn`` returns arrays (or lists, for nested types) of any length for each key. Spark sorts the rows; a task
    holds the keys of one call. ``nulls_last`` orders nulls as ``per_key`` does."""
    from pyspark.sql.pandas.types import to_arrow_type

    out_schema = T.StructType([df.schema[by], *T._parse_datatype_string(f"struct<{schema}>").fields])
    kinds = [to_arrow_type(f.dataType) for f in out_schema.fields[1:]]

    def called(table: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        arrays = {c: table[c].to_numpy(zero_copy_only=False) for c in cols}
        starts = np.flatnonzero(new)
        split = {c: np.split(x, starts[1:]) for c, x in arrays.items()}
        got = fn([{c: split[c][j] for c in cols} for j in range(len(starts))])
        made = [pa.array([x for g in got for x in g[n]], t) if isinstance(got[0][n], list) else pa.array(np.concatenate([g[n] for g in got])).cast(t) for n, t in zip(out_schema.names[1:], kinds)]
        of = np.repeat(starts, [len(g[out_schema.names[1]]) for g in got])
        return pa.RecordBatch.from_arrays([table[by].combine_chunks().take(pa.array(of)), *made], names=out_schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            new = table["_new"].to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(new)[-1])  # the last key may go on
            if last:
                yield called(table.slice(0, last), new[:last])
            held, n = table.slice(last).to_batches(), len(table) - last
        if n:
            table = pa.Table.from_batches(held)
            yield called(table, table["_new"].to_numpy(zero_copy_only=False))

    new = (F.row_number().over(Window.partitionBy(by).orderBy(*[F.asc_nulls_last(c) if nulls_last else c for c in order])) == 1).alias("_new")
    return df.select(*dict.fromkeys([by, *order, *cols]), new).select(*dict.fromkeys([by, *cols]), "_new").mapInArrow(run, out_schema)


# --- hidden states ----------------------------------------------------------------------------------


def kalman_trend(df: DataFrame, by: str, order: Sequence[str], v: str, idx: str, rounds: int = 5) -> DataFrame:
    def run(a: Arrays) -> Arrays:
        level, slope = regimes.kalman_trend(a[v].astype(float), rounds)
        return {idx: a[idx], "level": level, "slope": slope}

    return per_key(df, by, order, [v, idx], run, f"{idx} bigint, level double, slope double")


def momentum_signals(df: DataFrame, by: str, order: Sequence[str], v: str, idx: str, h: float = 1.0, drift: float = 0.0) -> DataFrame:
    """Log returns, clipped at 5 deviations, through the Kalman trend; entry while the slope turns positive, exit on
    a downward CUSUM alarm of the slope."""

    def run(a: Arrays) -> Arrays:
        r = np.diff(np.log(np.maximum(a[v].astype(float), 1)), prepend=0.0)
        r[:1] = 0.0
        s = r.std()
        level, slope = regimes.kalman_trend(np.clip(r, r.mean() - 5 * s, r.mean() + 5 * s) if s > 0 else r)
        _, _, alarm = dsp.cusum(level, h, drift)
        return {idx: a[idx], "level": level, "slope": slope, "entry": (level > 0) & np.append(False, level[:-1] <= 0), "exit": alarm}

    return per_key(df, by, order, [v, idx], run, f"{idx} bigint, level double, slope double, entry boolean, exit boolean")


def hmm_regime(df: DataFrame, by: str, order: Sequence[str], v: str, idx: str, k: int = 3) -> DataFrame:
    """State, rows in it and P(to the lowest state) from a key's own log returns (fitted on its whole history)."""

    def run(keys: list[Arrays]) -> list[Arrays]:
        returns = [np.diff(np.log(np.maximum(a[v].astype(float), 1)), prepend=0.0) for a in keys]
        for r in returns:
            r[:1] = 0.0
        return [{idx: a[idx], **found} for a, found in zip(keys, regimes.hmm_regimes(returns, k))]

    return many_keys(df, by, order, [v, idx], run, f"{idx} bigint, state int, duration int, p_down double")


# --- paths ------------------------------------------------------------------------------------------


def _path(a: Arrays, cols: Sequence[str]) -> np.ndarray:
    return np.stack([a[c].astype(float) for c in cols], axis=1)


def resampled(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], n: int, how: str = "arc") -> DataFrame:
    """One row for each key: ``path``, n points as an array of arrays."""
    fn = paths.resample_arc if how == "arc" else paths.resample_linear
    return many_keys(df, by, order, cols, lambda keys: [{"path": [fn(_path(a, cols), n).tolist()]} for a in keys], "path array<array<double>>", nulls_last=True)


def _tiles(df: DataFrame, key: str, path: str, block: int, *more: str) -> DataFrame:
    """Rows of a table of paths dealt to pairs (i, j) of blocks, a task for each pair; each row goes to one task for each block, not to one for each other row.
    Small tables have more blocks than they need, so that there is work for many tasks."""
    rows = df.count()
    n = max(1, -(-rows // block), min(FEW_BLOCKS, rows // SMALL_BLOCK))
    own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    dealt = df.select(F.col(key).alias("k"), F.col(path).cast("array<array<double>>").alias("p"), *more, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "p", *more)
    return dealt.repartition(min(MOST_TASKS, n * (n + 1) // 2), "i", "j")


def _distances(table: pa.Table, distance: str, w: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, other rows and the distances to them (until the next ones are asked for), each pair of a tile once; paths of one shape are measured together."""
    own, keys, i = table["own"].to_numpy(), table["k"].to_pylist(), table["i"][0].as_py()
    points = [np.array(p, float) for p in table["p"].to_pylist()]
    same = i == table["j"][0].as_py()
    shapes: dict[tuple, list[int]] = {}
    order = sorted(range(len(keys)), key=keys.__getitem__)
    place = np.empty(len(keys), int)
    place[order] = np.arange(len(keys))
    for r in order:
        if same or own[r] != i:
            shapes.setdefault(points[r].shape, []).append(r)
    left = order if same else [r for r in order if own[r] == i]
    for some in (g[a : a + paths.AT_ONCE] for g in shapes.values() for a in range(0, len(g), paths.AT_ONCE)):
        many, rows, measured = np.stack([points[r] for r in some]), np.array(some), {}
        for a in left:
            start = int(np.searchsorted(place[rows], place[a], "right")) if same else 0
            if start < len(rows):
                n = len(points[a])
                if n not in measured:
                    measured[n] = paths.distances_to(many, n, distance, w)
                yield a, rows[start:], measured[n](points[a])[start:]


def _pairs(table: pa.Table, distance: str, w: float) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of a tile, in batches of about PAIRS rows."""
    keys, t = table["k"].to_numpy(zero_copy_only=False), table.schema.field("k").type
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    n = 0

    def batch() -> pa.RecordBatch:
        x = np.repeat(keys[[r for r, _, _ in held]], [len(o) for _, o, _ in held])
        y, far = keys[np.concatenate([o for _, o, _ in held])], np.concatenate([d for _, _, d in held])
        swap = x > y
        return pa.RecordBatch.from_arrays([pa.array(np.where(swap, y, x), t), pa.array(np.where(swap, x, y), t), pa.array(far, pa.float64())], names=["a", "b", "distance"])

    for r, others, d in _distances(table, distance, w):
        held.append((r, others, d.copy()))
        n += len(others)
        if n >= PAIRS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def pairwise(df: DataFrame, key: str, path: str, distance: str = "dtw", block: int = BLOCK, w: float = 0.5) -> DataFrame:
    """(a, b, distance) of all pairs a < b of a table of paths, block against block. A task holds two blocks and hands on its pairs in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs(pa.Table.from_batches(batches), distance, w)

    kind = df.schema[key].dataType
    return _tiles(df, key, path, block).groupBy("i", "j").applyInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.DoubleType())]))


def classify_by_paths(df: DataFrame, key: str, path: str, label: str, distance: str = "shape", block: int = BLOCK, w: float = 0.5) -> DataFrame:
    """Class with the smallest mean distance for each key from all other keys. A pair of blocks hands on sums by key and class, no pairs."""
    kind, of = df.schema[key].dataType, df.schema[label].dataType

    def run(table: pa.Table) -> pa.Table:
        code = table["label"].combine_chunks().dictionary_encode(null_encoding="encode")
        at, classes = code.indices.to_numpy(), code.dictionary
        total, n = np.zeros((len(classes), len(at))), np.zeros((len(classes), len(at)), int)
        for r, others, d in _distances(table, distance, w):
            of_others = at[others]
            total[:, r] += np.bincount(of_others, d, len(classes))
            n[:, r] += np.bincount(of_others, minlength=len(classes))
            total[at[r], others] += d
            n[at[r], others] += 1
        c, row = np.nonzero(n)
        return pa.table([table["k"].combine_chunks().take(pa.array(row)), classes.take(pa.array(c)), pa.array(total[c, row]), pa.array(n[c, row], pa.int64())], names=["k", "label", "total", "n"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("label", of), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    sums = _tiles(df.withColumnRenamed(label, "label"), key, path, block, "label").groupBy("i", "j").applyInArrow(run, schema)
    mean = sums.groupBy("k", "label").agg((F.sum("total") / F.sum("n")).alias("mean_distance"))
    return mean.groupBy(F.col("k").alias(key)).agg(F.min_by("label", F.struct("mean_distance", "label")).alias("nearest"), F.min("mean_distance").alias("mean_distance"))


def classify_by_dtw(distances: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Class with the smallest mean distance for each key, from pair distances and known labels."""
    both = distances.select("a", "b", "distance").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    mean = both.join(labels.select(F.col(key).alias("b"), label), "b").groupBy("a", label).agg(F.avg("distance").alias("mean_distance"))
    return mean.groupBy(F.col("a").alias(key)).agg(F.min_by(label, F.struct("mean_distance", label)).alias("nearest"), F.min("mean_distance").alias("mean_distance"))


# --- episodes and trades ----------------------------------------------------------------------------


def episodes(df: DataFrame, by: str, order: Sequence[str], v: str, roc: str, **how) -> DataFrame:
    return per_key(df, by, order, [v, roc], lambda a: trades.episodes(a[v].astype(float), a[roc].astype(float), **how), EPISODE)


def simulate(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], fn: Callable[[Arrays], list[dict]]) -> DataFrame:
    """Whole-position trades of each key; ``fn`` maps its ordered arrays to trades (see ``kernels.trades``)."""
    return per_key(df, by, order, cols, fn, TRADE)


def sweep(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], configs: dict[str, object], fn: Callable[[Arrays, object], list[dict]]) -> DataFrame:
    """Trades of each key under every configuration, with ``cfg``; the grid is looped inside the task."""
    return per_key(df, by, order, cols, lambda a: [t | {"cfg": name} for name, c in configs.items() for t in fn(a, c)], TRADE + ", cfg string")


def partial_returns(df: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], fn: Callable[[Arrays], tuple[float, list[dict]] | float]) -> DataFrame:
    """(key, ret, n_sales) of strategies that sell in parts."""

    def run(a: Arrays) -> list[dict]:
        got = fn(a)
        ret, sales = got if isinstance(got, tuple) else (got, [])
        return [{"ret": float(ret), "n_sales": len(sales)}]

    return per_key(df, by, order, cols, run, "ret double, n_sales int")


def simulate_funnel(df: DataFrame, by: str, order: Sequence[str], v: str, candidate: str, score: str, action: str, threshold: float, **how) -> DataFrame:
    """Trades of the funnel (see ``kernels.trades``) on many keys at a time."""
    kinds = {"entry_idx": np.int32, "ret": float, "held": np.int32, "best": float}

    def run(keys: list[Arrays]) -> list[Arrays]:
        got = [trades.funnel(a[v].astype(float), a[candidate].astype(bool), a[score].astype(float), list(a[action]), threshold, **how) for a in keys]
        return [{n: np.array([t[n] for t in found], kind) for n, kind in kinds.items()} for found in got]

    return many_keys(df, by, order, [v, candidate, score, action], run, "entry_idx int, ret double, held int, best double")


# --- survival regression ----------------------------------------------------------------------------


def cox_ph(df: DataFrame, duration: str, observed: str, covars: Sequence[str], ridge: float = 0.1, rounds: int = 8, tolerance: float = 1e-7) -> dict:
    """Cox proportional hazards (Breslow ties, ridge). Each Newton step sums e^(bx), x e^(bx) and x x e^(bx) by distinct
    duration and adds them up from the longest duration on, in ranges; the driver gets the gradient and the Hessian."""
    d = len(covars)
    z = df.select(F.col(duration).cast("double").alias("t"), F.col(observed).cast("int").alias("o"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covars)]).na.drop()
    moments = z.agg(*[x for i in range(d) for x in (F.avg(f"x{i}"), F.stddev_pop(f"x{i}"))]).first()
    z = z.select("t", "o", *[((F.col(f"x{i}") - F.lit(moments[2 * i])) / F.lit(moments[2 * i + 1] or 1.0)).alias(f"x{i}") for i in range(d)])
    z = stats.written_once(z)
    cuts = stats.range_cuts(z, "t")
    beta = np.zeros(d)
    for _ in range(rounds):
        e = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.col(f"x{i}") * float(beta[i]) for i in range(d)), F.lit(0.0)))))
        first = {f"a{i}": F.col(f"x{i}") for i in range(d)}
        second = {f"b{i}_{j}": F.col(f"x{i}") * F.col(f"x{j}") for i in range(d) for j in range(d)}
        g = z.withColumn("e", e).groupBy((-F.col("t")).alias("t")).agg(F.sum("o").alias("n"), F.sum("e").alias("s0"), *[F.sum(x * F.col("e")).alias(name) for name, x in (first | second).items()], *[F.sum(F.col(f"x{i}") * F.col("o")).alias(f"c{i}") for i in range(d)])
        at_risk = stats.running_totals(g, "t", {f"r_{c}": c for c in ("s0", *first, *second)}, cuts=sorted(-x for x in cuts), inclusive=True)
        mean = [F.col(f"r_a{i}") / F.col("r_s0") for i in range(d)]
        pulls = [F.sum(F.col(f"c{i}") - F.col("n") * mean[i]) for i in range(d)]
        bends = [F.sum(F.col("n") * (F.col(f"r_b{i}_{j}") / F.col("r_s0") - mean[i] * mean[j])) for i in range(d) for j in range(d)]
        got = np.array(at_risk.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"q{i}") for i, x in enumerate([*pulls, *bends])]).first(), float)  # one row
        gradient = got[:d] - ridge * beta
        hessian = got[d:].reshape(d, d) + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    scale = np.array([moments[2 * i + 1] or 1.0 for i in range(d)])
    return {"coef": dict(zip(covars, (beta / scale).tolist())), "gradient": float(np.abs(gradient).max())}
