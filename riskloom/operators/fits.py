"""Many penalised linear fits in one pass over the rows.

Rows are packed once into blocks of numbers. Every row carries, per way of splitting,
the fold it belongs to; a fit is trained on one way's rows without one fold, so all
folds, candidates and panels are fitted together: an iteration is one aggregate over
the blocks that gives gradient and curvature of every open fit, and fits that have
converged drop out. Means, deviations and F statistics of all training sets come
from sums per fold: total minus the fold that is held out.

The driver and each reducing task see sums per fit, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import ship_package

#: A fit's curvature has (features + 1)² numbers and is not formed beyond so many features.
MAX_FEATURES = 512
BLOCK_ROWS = 2_048
#: Rows that a task reads at most where there are more tasks than run at once: a task's
#: sums are as long for few rows as for many.
TASK_ROWS = 65_536
#: Bytes of sums that travel as one row, and tasks from which partial rows are added up in two steps.
BUNDLE_BYTES, SLOTS = 1 << 20, 16
SWEEPS = 200
OUTSIDE, NOBODY = -1, -2


@dataclass(frozen=True)
class Fit:
    """Train on rows of ``column`` that are inside and not in fold ``held_out``.

    The mean loss plus penalty · (ratio · |β|₁ + (1 - ratio) / 2 · |β|²) is minimised over
    the ``allowed`` features (all, if None), standardised on the training rows.
    """

    column: int = 0
    held_out: int = NOBODY
    penalty: float = 0.0
    ratio: float = 0.0
    allowed: frozenset[int] | None = None
    #: Weights of cases and controls, times the rows' own.
    case: float = 1.0
    control: float = 1.0


@dataclass(frozen=True)
class Blocks:
    """Packed rows; values are shifted and scaled by one number per feature."""

    frame: DataFrame
    shift: np.ndarray
    scale: np.ndarray
    columns: int
    folds: int
    id_type: str
    #: At most so many tasks read the blocks.
    tasks: int

    def release(self) -> None:
        self.frame.unpersist()


@dataclass(frozen=True)
class Fitted:
    """Coefficients of raw values with intercepts, and of standardised values."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    standardised: np.ndarray
    passes: int


def pack(df: DataFrame, folds: int, columns: int = 1) -> Blocks:
    """Blocks of (id, y, weight, features, member) rows.

    ``member`` has a fold from 0, or -1 for outside, per column; a row's features are
    complete. The blocks are kept in memory and on disk until ``release``.
    """
    spark = df.sparkSession
    ship_package(spark)
    first = df.agg(
        F.count("*").alias("n"), Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")
    ).first()
    n = first["n"]
    shift, scale = first["s"]["mean"].toArray(), first["s"]["std"].toArray()
    scale = np.where(scale > 0, scale, 1.0)
    id_type = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                k = part.num_rows
                flat = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4)]
                x = (flat[0].reshape(k, len(shift)) - shift) / scale
                ids = pa.ListArray.from_arrays(pa.array([0, k], pa.int32()), part.column(0))
                blobs = [
                    x.astype("<f8"), part.column(1).to_numpy().astype("<f8"),
                    part.column(2).to_numpy().astype("<f8"), flat[1].astype("<i2"),
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["ids", "x", "y", "w", "m"]
                )

    rows = df.select(
        "id", F.col("y").cast("double"), F.col("weight").cast("double"), vector_to_array("features"), "member"
    )
    at_once = spark.sparkContext.defaultParallelism
    tasks = max(1, min(n // BLOCK_ROWS, at_once), n // TASK_ROWS)
    # What is read may stand in one file and task, so the tasks follow the rows; sorted,
    # blocks are the same in a rerun.
    dealt = rows.coalesce(1) if tasks == 1 else rows.repartition(tasks, "id").sortWithinPartitions("id")
    packed = dealt.mapInArrow(
        run, f"ids array<{id_type}>, x binary, y binary, w binary, m binary"
    )
    return Blocks(packed.persist(StorageLevel.MEMORY_AND_DISK), shift, scale, columns, folds, id_type, tasks)


def _opened(batch: pa.RecordBatch, features: int, columns: int) -> Iterator[tuple]:
    """(ids, x, y, w, member) of each block."""
    ids = batch.column(0)
    for i in range(batch.num_rows):
        x, y, w, m = (
            np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, "<f8"), (2, "<f8"), (3, "<f8"), (4, "<i2"))
        )
        yield ids[i].values, x.reshape(-1, features), y, w, m.reshape(-1, columns)


def _added(rows: Iterable[bytes]) -> np.ndarray:
    return np.sum([np.frombuffer(b, "<f8") for b in rows], axis=0)


def _finished(partials: DataFrame, tasks: int, finish) -> DataFrame:
    """(bundle, blob): ``finish(bundle, sums)`` of the partial sums of each bundle.

    One task's rows are finished where they are, few tasks' rows in one step, and those
    of more than SLOTS tasks are added up in groups first, as many as the root of the tasks.
    """
    schema = "bundle int, blob binary"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        bundle = int(rows["bundle"].iloc[0])
        blob = finish(bundle, _added(rows["blob"])).astype("<f8").tobytes()
        return pd.DataFrame({"bundle": [bundle], "blob": [blob]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                yield one(batch.iloc[i : i + 1])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bundle": rows["bundle"].iloc[:1], "blob": [_added(rows["blob"]).tobytes()]})

    if tasks == 1:
        return partials.mapInPandas(each, schema)
    if tasks > SLOTS:
        partials = partials.groupBy("bundle", "slot").applyInPandas(add, schema)
    return partials.groupBy("bundle").applyInPandas(one, schema)


def _sums(blocks: Blocks, bundles: Sequence, measure, finish) -> dict[int, np.ndarray]:
    """``finish(bundle, sums)`` per bundle, of ``measure(bundle, x, y, w, m)`` added up over all blocks."""
    p, columns, slots = len(blocks.shift), blocks.columns, math.isqrt(blocks.tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, y, w, m in _opened(batch, p, columns):
                for b in bundles:
                    sums = measure(b, x, y, w, m)
                    totals[b] = totals[b] + sums if b in totals else sums
        slot = TaskContext.get().partitionId() % slots
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(totals), pa.int32()),
                pa.array([slot] * len(totals), pa.int32()),
                pa.array([t.astype("<f8").tobytes() for t in totals.values()], pa.binary()),
            ],
            ["bundle", "slot", "blob"],
        )

    partials = blocks.frame.mapInArrow(run, "bundle int, slot int, blob binary")
    # A row for each bundle of fits.
    found = _finished(partials, blocks.tasks, finish).collect()
    return {r["bundle"]: np.frombuffer(r["blob"], "<f8") for r in found}


@dataclass(frozen=True)
class Moments:
    """Sums per (column, fold, class) in block units: rows, weights, values, squares."""

    rows: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    squares: np.ndarray

    def training(self, fit: Fit) -> Moments:
        """Sums per class of a fit's training rows: the total without the held-out fold."""

        def rest(a: np.ndarray) -> np.ndarray:
            whole = a[fit.column].sum(0)
            return whole - a[fit.column, fit.held_out] if fit.held_out >= 0 else whole

        return Moments(*map(rest, (self.rows, self.weights, self.values, self.squares)))

    def scaling(self, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sample deviation of each feature on a fit's training rows."""
        t = self.training(fit)
        n = t.rows.sum()
        mean = t.values.sum(0) / max(n, 1)
        spread = np.maximum(t.squares.sum(0) - n * mean**2, 0.0) / max(n - 1, 1)
        return mean, np.sqrt(spread)

    def f_scores(self, fit: Fit) -> np.ndarray:
        """F statistic of each feature on a fit's training rows; NaN where it has none."""
        t = self.training(fit)
        n0, n1 = t.rows.astype(float)
        if not n0 or not n1:
            return np.full(t.values.shape[1], np.nan)
        gap = t.values[1] / n1 - t.values[0] / n0
        inside = np.maximum(t.squares - t.values**2 / t.rows[:, None], 0.0).sum(0)
        inside[inside <= 1e-12 * t.squares.sum(0)] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            f = n0 * n1 / (n0 + n1) * gap**2 / (inside / (n0 + n1 - 2))
        return np.where(inside > 0, f, np.nan)

    def best(self, fit: Fit, k: int, within: frozenset[int] | None = None) -> frozenset[int]:
        """The ``k`` features with the largest F (without any: the largest variance); ties to the first."""
        score = self.f_scores(fit)
        if np.isnan(score).all():
            score = self.scaling(fit)[1]
        inside = range(len(score)) if within is None else within
        order = sorted((j for j in inside if score[j] == score[j]), key=lambda j: (-score[j], j))
        return frozenset(order[:k])


def moments(blocks: Blocks) -> Moments:
    """One pass for the sums of all folds of all columns."""
    p, columns, folds = len(blocks.shift), blocks.columns, blocks.folds

    def measure(_, x, y, w, m):
        both = np.concatenate([np.ones((len(y), 1)), w[:, None], x, x * x], axis=1)
        out = np.zeros((columns, folds, 2, both.shape[1]))
        for o in range(columns):
            for g in range(folds):
                for c in (0, 1):
                    out[o, g, c] = both[(m[:, o] == g) & (y == c)].sum(0)
        return out.ravel()

    total = _sums(blocks, [0], measure, lambda _, sums: sums).get(0, np.zeros(columns * folds * 2 * (2 * p + 2)))
    total = total.reshape(columns, folds, 2, 2 * p + 2)
    return Moments(total[..., 0].astype(np.int64), total[..., 1], total[..., 2 : p + 2], total[..., p + 2 :])


def _loss(kind: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature at margins ``z`` (rows × fits) of 0/1 outcomes."""
    side = (2.0 * y - 1.0)[:, None]
    if kind == "logistic":
        prob = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        return np.logaddexp(0.0, -side * z), prob - y[:, None], prob * (1.0 - prob)
    if kind == "squared_hinge":
        short = np.maximum(1.0 - side * z, 0.0)
        return short**2, -2.0 * side * short, 2.0 * (short > 0)
    raise ValueError(f"unknown loss: {kind}")


def _shrunk(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - by, 0.0)


def _settled(gradient, curvature, beta, step, open_, l1, l2) -> tuple[np.ndarray, np.ndarray]:
    """Exact steps if the present signs hold to the end, and for which fits they do."""
    width = beta.shape[1]
    sign = np.sign(beta + step)
    on = open_ & ((sign != 0) | (l1 == 0))
    off = np.where(on | ~open_, 0.0, -beta)
    pairs = on[:, :, None] & on[:, None, :]
    diagonal = np.where(on, l2 + 1e-14, 1.0)
    system = np.where(pairs, curvature, 0.0)
    system[:, range(width), range(width)] += diagonal
    known = -(gradient + l2 * beta + l1 * sign) - np.einsum("fij,fj->fi", curvature, off)
    try:
        exact = np.linalg.solve(system, np.where(on, known, 0.0)[:, :, None])[:, :, 0] + off
    except np.linalg.LinAlgError:
        return step, np.zeros(len(beta), bool)
    signs = np.where(on & (l1 > 0), np.sign(beta + exact) == sign, True).all(1)
    slope = gradient + np.einsum("fij,fj->fi", curvature, exact)
    zeros = np.where(open_ & ~on, np.abs(slope) <= l1 + 1e-12, True).all(1)
    return exact, signs & zeros & np.isfinite(exact).all(1)


def _newton(gradient, curvature, beta, open_, lasso, ridge) -> tuple[np.ndarray, np.ndarray]:
    """Steps to the minimum of each fit's quadratic model, and distances from optimality.

    Coordinates move in turn, all fits at once, until the signs of a fit are those of
    its minimum; then one linear system ends it. The last coordinate is the
    intercept, without penalty.
    """
    fits, width = beta.shape
    free = np.arange(width) == width - 1
    l1 = np.where(free, 0.0, lasso[:, None])
    l2 = np.where(free, 0.0, ridge[:, None])
    gap = np.where(open_, beta - _shrunk(beta - gradient - l2 * beta, l1), 0.0)
    diagonal = np.maximum(curvature[:, range(width), range(width)] + l2, 1e-14)
    step, moved = np.zeros_like(beta), np.zeros_like(beta)
    left = np.arange(fits)
    for sweep in range(SWEEPS):
        if sweep % 4 == 0:
            exact, ok = _settled(*(a[left] for a in (gradient, curvature, beta, step, open_, l1, l2)))
            step[left[ok]] = exact[ok]
            left = left[~ok]
            if not len(left):
                break
            g, h, b, o, a1, a2, d = (a[left] for a in (gradient, curvature, beta, open_, l1, l2, diagonal))
        s, m = step[left], moved[left]
        for k in range(width):
            at = b[:, k] + s[:, k]
            slope = g[:, k] + m[:, k] + a2[:, k] * at
            new = _shrunk(d[:, k] * at - slope, a1[:, k]) / d[:, k]
            change = np.where(o[:, k], new - at, 0.0)
            s[:, k] += change
            m += h[:, :, k] * change[:, None]
        step[left], moved[left] = s, m
    return step, np.abs(gap).max(1)


def fit_many(
    blocks: Blocks,
    sums: Moments,
    fits: Sequence[Fit],
    loss: str = "logistic",
    start: Fitted | None = None,
    tol: float = 1e-7,
    max_passes: int = 100,
) -> Fitted:
    """Fit all of ``fits`` together by proximal Newton steps.

    ``tol`` bounds the distance from optimality in standardised units. A feature that is
    constant on a fit's training rows gets coefficient 0, a training set of one class
    an intercept as far as the passes go. ``start`` holds earlier coefficients of
    the same fits.
    """
    p, n_fits = len(blocks.shift), len(fits)
    if p > MAX_FEATURES:
        raise ValueError(f"{p} features: curvature is formed for at most {MAX_FEATURES}")
    if not n_fits:
        return Fitted(np.zeros((0, p)), np.zeros(0), np.zeros((0, p + 1)), 0)
    known: dict[tuple[int, int], tuple] = {}
    for f in fits:
        if (f.column, f.held_out) not in known:
            known[f.column, f.held_out] = (*sums.scaling(f), sums.training(f).weights)
    mean = np.array([known[f.column, f.held_out][0] for f in fits])
    sd = np.array([known[f.column, f.held_out][1] for f in fits])
    by_class = np.array([(f.control, f.case) for f in fits])
    weight = (by_class * [known[f.column, f.held_out][2] for f in fits]).sum(1)
    varies = sd > 1e-9
    sd = np.where(varies, sd, 1.0)
    open_ = np.ones((n_fits, p + 1), bool)
    open_[:, :p] = varies
    for i, f in enumerate(fits):
        if f.allowed is not None:
            open_[i, :p] &= np.isin(np.arange(p), list(f.allowed))
    lasso = np.array([f.penalty * f.ratio for f in fits])
    ridge = np.array([f.penalty * (1.0 - f.ratio) for f in fits])
    column, held = np.array([f.column for f in fits]), np.array([f.held_out for f in fits])
    size = (p + 1) * (p + 2) + 1
    per = max(1, BUNDLE_BYTES // (8 * size))

    beta = np.zeros((n_fits, p + 1)) if start is None else start.standardised.copy()
    beta[~open_] = 0.0
    trial, value, halved = beta.copy(), np.full(n_fits, np.inf), np.zeros(n_fits, int)
    left, passes = np.arange(n_fits), 0
    context = blocks.frame.sparkSession.sparkContext
    while len(left) and passes < max_passes:
        passes += 1
        slope = trial[left, :p] / sd[left]
        shared = context.broadcast(
            {
                b: (
                    slope[b * per : (b + 1) * per],
                    trial[part, p] - (slope[b * per : (b + 1) * per] * mean[part]).sum(1),
                    column[part], held[part], mean[part], sd[part], weight[part], lasso[part], ridge[part],
                    open_[part], trial[part], by_class[part],
                )
                for b, part in enumerate(np.split(left, range(per, len(left), per)))
            }
        )

        def measure(b, x, y, w, m):
            coef, base, cols, out = shared.value[b][:4]
            inside = m[:, cols]
            inside = (inside != OUTSIDE) & (inside != out)
            z = x @ coef.T + base
            cost, first, second = _loss(loss, z, y)
            inside = inside * w[:, None] * shared.value[b][11][:, y.astype(int)].T
            sums_ = np.zeros((len(cols), size))
            sums_[:, 0] = (cost * inside).sum(0)
            one = np.concatenate([x, np.ones((len(y), 1))], axis=1)
            sums_[:, 1 : p + 2] = (first * inside).T @ one
            second = second * inside
            for j in range(len(cols)):
                sums_[j, p + 2 :] = ((one * second[:, j : j + 1]).T @ one).ravel()
            return sums_.ravel()

        def step(b: int, got: np.ndarray) -> np.ndarray:
            _, _, _, _, mu, dev, total, l1, l2, free, at, _ = shared.value[b]
            got = got.reshape(len(total), size) / np.maximum(total, 1e-300)[:, None]
            # From block units to the standardised ones of each fit.
            turn = np.zeros((len(total), p + 1, p + 1))
            turn[:, range(p), range(p)] = 1.0 / dev
            turn[:, :p, p] = -mu / dev
            turn[:, p, p] = 1.0
            gradient = np.einsum("fij,fj->fi", turn, got[:, 1 : p + 2])
            curvature = turn @ got[:, p + 2 :].reshape(-1, p + 1, p + 1) @ turn.transpose(0, 2, 1)
            move, far = _newton(gradient, curvature, at, free, l1, l2)
            coef = at[:, :p]
            objective = got[:, 0] + l1 * np.abs(coef).sum(1) + l2 / 2 * (coef**2).sum(1)
            return np.concatenate([objective[:, None], far[:, None], move], axis=1)

        n_bundles = -(-len(left) // per)
        got = _sums(blocks, range(n_bundles), measure, step)
        result = np.concatenate([got[b].reshape(-1, p + 3) for b in range(n_bundles)])
        shared.destroy()
        better = result[:, 0] <= value[left] + 1e-12 * np.abs(value[left])
        better |= ~np.isfinite(value[left]) & np.isfinite(result[:, 0])
        won, lost = left[better], left[~better]
        beta[won], value[won], halved[won] = trial[won], result[better, 0], 0
        trial[won] = beta[won] + result[better, 2:]
        trial[lost] = (trial[lost] + beta[lost]) / 2
        halved[lost] += 1
        done = np.zeros(len(left), bool)
        done[better] = result[better, 1] <= tol
        done |= halved[left] > 30
        left = left[~done]
    raw = beta[:, :p] / sd / blocks.scale
    centre = blocks.shift + mean * blocks.scale
    return Fitted(raw, beta[:, p] - (raw * centre).sum(1), beta, passes)


def fold_scores(
    blocks: Blocks, fitted: Fitted, plan: Mapping[tuple[int, int], Sequence[int]], link: str = "logistic"
) -> DataFrame:
    """(id, y_true, column, fold, scores): rows of a (column, fold) scored by the fits listed for it.

    ``scores`` has one number per listed fit, in their order; a row appears once for
    each column in whose plan it is.
    """
    p, columns = len(blocks.shift), blocks.columns
    # Coefficients of the shifted and scaled values of the blocks.
    coef = fitted.coefficients * blocks.scale
    base = fitted.intercepts + fitted.coefficients @ blocks.shift
    listed = [(o, g, np.array(list(ids))) for (o, g), ids in plan.items()]
    shared = blocks.frame.sparkSession.sparkContext.broadcast((coef, base, listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, base, listed = shared.value
        for batch in batches:
            for ids, x, y, _, m in _opened(batch, p, columns):
                for o, g, use in listed:
                    here = np.flatnonzero(m[:, o] == g)
                    if not len(here):
                        continue
                    z = x[here] @ coef[use].T + base[use]
                    if link == "logistic":
                        z = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                    ends = np.arange(0, z.size + 1, len(use), dtype=np.int32)
                    k = len(here)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(here)), pa.array(y[here].astype(np.int32)),
                            pa.array(np.full(k, o, np.int32)), pa.array(np.full(k, g, np.int32)),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel())),
                        ],
                        ["id", "y_true", "column", "fold", "scores"],
                    )

    return blocks.frame.mapInArrow(
        run, f"id {blocks.id_type}, y_true int, column int, fold int, scores array<double>"
    )


def elimination_paths(
    blocks: Blocks,
    sums: Moments,
    fits: Sequence[Fit],
    names: Sequence[str],
    smallest: int,
    step: int = 1,
    loss: str = "logistic",
    tol: float = 1e-5,
    always: frozenset[int] = frozenset(),
) -> list[tuple[list[frozenset[int]], Fitted]]:
    """Per fit: nested feature sets down to ``smallest``, and the fit on each of them.

    Features in ``always`` are in every set and do not count.

    All fits go down together. The fit on a smaller set starts from the larger one's
    coefficients; the features with the smallest standardised coefficients leave,
    of equal ones those with the smaller names.
    """
    current = [f.allowed if f.allowed is not None else frozenset(range(len(names))) for f in fits]
    last = None
    seen: list[list[tuple]] = [[] for _ in fits]
    while True:
        last = fit_many(
            blocks, sums, [replace(f, allowed=c) for f, c in zip(fits, current, strict=True)], loss, last, tol
        )
        for i, chosen in enumerate(current):
            seen[i].append((chosen, last.coefficients[i], last.intercepts[i], last.standardised[i]))
        if all(len(c - always) <= smallest for c in current):
            break
        for i, chosen in enumerate(current):
            weight = np.abs(last.standardised[i])
            free = sorted(chosen - always, key=lambda j: (weight[j], names[j]))
            current[i] = chosen - set(free[: min(step, max(0, len(free) - smallest))])
    paths = []
    for entries in seen:
        sets, coef, base, std = zip(*entries, strict=True)
        paths.append((list(sets), Fitted(np.array(coef), np.array(base), np.array(std), 0)))
    return paths
