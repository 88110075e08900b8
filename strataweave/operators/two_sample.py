"""Classifier two-sample tests between neighbouring loads.

For each pair of neighbouring loads, two-fold cross-fitted logistic regressions
on one-hot codes learn which load a row came from: on all columns, on all but
one (ablation) and on one alone. All models are fitted together by L-BFGS, which
needs a value and a gradient per model and no matrix of columns by columns.

Where the counted vectors are few, each pair is fitted and scored inside one task,
in a single job. Beyond ``LOCAL_VECTORS`` every round is a job: each partition
sends its share of each model's gradient, the shares are summed model by model on
the executors, and the driver takes the step. Both ways minimise the same
strictly convex functions and give the same figures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataweave.sources.storage import discard, materialize

#: Counted vectors of a table up to which a pair of loads is fitted inside one task.
LOCAL_VECTORS = 200_000
#: Rounds of value and gradient, and the largest mean gradient at which a model counts as fitted.
ROUNDS = 60
TOLERANCE = 1e-5
MEMORY = 5
RIDGE = 1.0
#: Bins of the log-odds in which scores are compared, finest around zero.
SCORE_BINS = 1024


class Discrimination(NamedTuple):
    pair: int
    column: int
    auc_all: float
    auc_without: float
    auc_alone: float


class _Rows(NamedTuple):
    """Counted vectors: ``at[i, j]`` is the place of column ``j``'s code among all parameters."""

    pair: np.ndarray
    later: np.ndarray
    fold: np.ndarray
    n: np.ndarray
    at: np.ndarray


def _variants(m: int) -> list[tuple[int, ...]]:
    """Column sets of the models: all, all but each, each alone; those that coincide once."""
    every = tuple(range(m))
    return list(dict.fromkeys([every, *(tuple(c for c in every if c != j) for j in every), *((j,) for j in every)]))


def discrimination(vectors: DataFrame, n_pairs: int, codes: list[int], local_vectors: int | None = None) -> list[Discrimination]:
    """Cross-fitted AUCs for each pair of loads and each column.

    ``vectors``: ``pair`` (from 0), ``later`` (1 for rows of the later load, else 0),
    ``fold`` (0 or 1), ``c0..``, ``n``, with ``c<j>`` below ``codes[j]``; ``n`` rows
    have these codes. Pairs without rows, and folds in which one class is missing,
    count as AUC 0.5. ``local_vectors`` replaces ``LOCAL_VECTORS``.
    """
    if n_pairs < 1:
        return []
    limit = LOCAL_VECTORS if local_vectors is None else local_vectors
    variants = _variants(len(codes))
    most = 4.0 * n_pairs * float(np.prod([float(c) for c in codes]))
    if most <= limit:
        auc = _fit_by_pair(vectors, n_pairs, codes, variants)
    else:
        written = materialize(vectors, "vectors")
        few = written.count() <= limit
        auc = _fit_by_pair(written, n_pairs, codes, variants) if few else _fit_by_rounds(written, n_pairs, codes, variants)
        discard(written)
    place = {v: i for i, v in enumerate(variants)}
    every = tuple(range(len(codes)))
    of = lambda p, v: float(auc[p, place[v]])
    return [
        Discrimination(p, j, of(p, every), of(p, tuple(c for c in every if c != j)), of(p, (j,))) for p in range(n_pairs) for j in every
    ]


def _read(batch: pa.RecordBatch | pa.Table, codes: list[int]) -> _Rows:
    starts = np.cumsum([1, *codes[:-1]])  # place 0 is the constant
    column = lambda name: batch[name].to_numpy()
    at = np.stack([starts[j] + column(f"c{j}").astype(np.int64) for j in range(len(codes))], 1)
    return _Rows(column("pair").astype(np.int64), column("later").astype(float), column("fold").astype(np.int64), column("n").astype(float), at)


def _log_odds(rows: _Rows, block: np.ndarray, beta: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    return beta[block, 0] + sum((beta[block, rows.at[:, c]] for c in columns), np.zeros(len(block)))


def _sums(rows: _Rows, beta: np.ndarray, variants: list[tuple[int, ...]]) -> np.ndarray:
    """Loss and gradient of each model over these rows, and after the models of a block the rows with each code.

    ``beta`` is ``(block, variant, parameter)``; the block of a row is the model that learns from it, that of its pair for the other fold.
    """
    blocks, _, d = beta.shape
    block = rows.pair * 2 + (1 - rows.fold)
    out = np.zeros((blocks, len(variants) + 1, d + 1))
    add = lambda at, w: np.bincount(block * d + at, w, blocks * d).reshape(blocks, d)
    sign = 2 * rows.later - 1
    for v, columns in enumerate(variants):
        z = _log_odds(rows, block, beta[:, v], columns)
        out[:, v, 0] = np.bincount(block, rows.n * np.logaddexp(0, -sign * z), blocks)
        miss = rows.n * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - rows.later)
        out[:, v, 1] = np.bincount(block, miss, blocks)
        for c in columns:
            out[:, v, 1:] += add(rows.at[:, c], miss)
    out[:, -1, 1] = np.bincount(block, rows.n, blocks)
    for c in range(rows.at.shape[1]):
        out[:, -1, 1:] += add(rows.at[:, c], rows.n)
    return out


def _score_counts(rows: _Rows, beta: np.ndarray, variants: list[tuple[int, ...]]) -> np.ndarray:
    """Held-out rows by ``(block, variant, class, bin of the log-odds)``."""
    blocks = len(beta)
    block = rows.pair * 2 + rows.fold
    out = np.zeros((blocks, len(variants), 2 * SCORE_BINS))
    for v, columns in enumerate(variants):
        z = _log_odds(rows, block, beta[:, v], columns)
        place = np.clip((np.arcsinh(z * 1e4) / 28 + 0.5) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)
        at = (block * 2 + rows.later.astype(np.int64)) * SCORE_BINS + place
        out[:, v] = np.bincount(at, rows.n, blocks * 2 * SCORE_BINS).reshape(blocks, -1)
    return out


def _auc(counts: np.ndarray) -> np.ndarray:
    """Areas under the curve by ``(pair, variant)``; ties count half, folds count by their pairs of rows."""
    old, new = np.moveaxis(counts.reshape(-1, 2, counts.shape[1], 2, SCORE_BINS), 3, 0)
    below = np.cumsum(old, -1) - old
    wins, pairs = (new * (below + old / 2)).sum(-1).sum(1), (old.sum(-1) * new.sum(-1)).sum(1)
    return np.where(pairs > 0, wins / np.maximum(pairs, 1), 0.5)


def _fit(shape: tuple[int, int, int], sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Parameters of all models by L-BFGS. ``sums`` gives what :func:`_sums` gives for all rows.

    A step that does not lower a model's loss enough is halved and tried again in the
    next round, while the other models go on. The first direction is scaled by
    the curvature at zero.
    """
    blocks, n_variants, d = shape
    k = blocks * n_variants
    at = np.zeros((k, d))
    step = np.zeros((k, d))  # from at to what is tried next
    value = slope = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        found = sums((at + step).reshape(shape))
        models = found[:, :-1].reshape(k, d + 1)
        if value is None:
            weight = np.repeat(found[:, -1, 1:], n_variants, 0)
            curve, size = weight / 4 + RIDGE, np.maximum(weight[:, :1], 1)
        new_at = at + step
        new_value = models[:, 0] + RIDGE / 2 * (new_at**2).sum(1)
        new_slope = models[:, 1:] + RIDGE * new_at
        if value is None:
            ok = np.ones(k, bool)
            value, slope = new_value, new_slope
        else:
            ok = new_value <= value + 1e-4 * (slope * step).sum(1) + 1e-12 * np.abs(value)
            s, y = np.where(ok[:, None], step, 0), np.where(ok[:, None], new_slope - slope, 0)
            curved = (s * y).sum(1)
            held = [*held[1 - MEMORY :], (s, y, np.divide(1, curved, out=np.zeros(k), where=curved > 1e-300))]
            at = np.where(ok[:, None], new_at, at)
            value, slope = np.where(ok, new_value, value), np.where(ok[:, None], new_slope, slope)
        done = (np.abs(slope) / size).max(1) <= TOLERANCE
        if done.all():
            break
        q, parts = slope.copy(), []
        for s, y, r in reversed(held):
            a = r * (s * q).sum(1)
            parts.append(a)
            q -= a[:, None] * y
        q /= curve
        for (s, y, r), a in zip(held, reversed(parts), strict=True):
            q += (a - r * (y * q).sum(1))[:, None] * s
        downhill = (q * slope).sum(1) > 0
        new_step = -np.where(downhill[:, None], q, slope / curve)
        step = np.where(done[:, None], 0, np.where(ok[:, None], new_step, step / 2))
    return at.reshape(shape)


def _fit_by_pair(vectors: DataFrame, n_pairs: int, codes: list[int], variants: list[tuple[int, ...]]) -> np.ndarray:
    """AUCs by ``(pair, variant)``; all vectors of a pair meet in one task, bounded by ``LOCAL_VECTORS``."""
    d = 1 + sum(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = _read(pa.Table.from_batches(held), codes)
        pairs, pair = np.unique(rows.pair, return_inverse=True)
        rows = rows._replace(pair=pair)
        beta = _fit((2 * len(pairs), len(variants), d), lambda b: _sums(rows, b, variants))
        out = [x.tobytes() for x in _auc(_score_counts(rows, beta, variants))]
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(out, pa.binary())], ["pair", "auc"])

    auc = np.full((n_pairs, len(variants)), 0.5)
    for r in vectors.repartition("pair").mapInArrow(run, "pair int, auc binary").collect():  # one row a pair
        auc[r["pair"]] = np.frombuffer(r["auc"], float)
    return auc


def _fit_by_rounds(vectors: DataFrame, n_pairs: int, codes: list[int], variants: list[tuple[int, ...]]) -> np.ndarray:
    shape = (n_pairs * 2, len(variants), 1 + sum(codes))

    def sums(beta: np.ndarray) -> np.ndarray:
        return _summed(vectors, codes, lambda rows: _sums(rows, beta, variants), (shape[0], shape[1] + 1, shape[2] + 1))

    beta = _fit(shape, sums)
    return _auc(_summed(vectors, codes, lambda rows: _score_counts(rows, beta, variants), (shape[0], shape[1], 2 * SCORE_BINS)))


def _summed(vectors: DataFrame, codes: list[int], share: Callable[[_Rows], np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """Sum over all partitions of the arrays that ``share`` makes, row by row, in two stages."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += share(_read(b, codes))
        flat = total.reshape(-1, shape[2])
        used = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([flat[k].tobytes() for k in used], pa.binary())], ["row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["row"].to_pylist(), b["sums"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["row", "sums"])

    out = np.zeros(shape)
    flat = out.reshape(-1, shape[2])
    schema = "row int, sums binary"
    for r in vectors.mapInArrow(shares, schema).repartition("row").mapInArrow(add, schema).collect():  # one row a model
        flat[r["row"]] = np.frombuffer(r["sums"], float)
    return out
