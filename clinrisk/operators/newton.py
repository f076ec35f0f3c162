"""Many logistic regressions at once, one pass over the data per Newton step.

Each pass computes loss, gradient and Hessian of *all* running fits: tasks reduce their partition with matrix products to
one small block per fit, Spark sums the blocks, and the driver solves systems of the size of the feature list. A fit needs
about ten passes where a first-order solver needs a hundred, and a whole grid search needs no more passes than one fit.

The rows are packed once into binary blocks of about a megabyte, so that a pass hands over a few large values instead of
converting every number again. Fits that stand at the same coefficients share the products of a row, whatever their folds
and weights.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECREASE_TOLERANCE = 1e-10
INTERIOR_STEPS = 100
MAX_BLOCKS = 128
# Tasks of a pass for each core; a task folds all its input into one block per fit.
TASKS_PER_CORE = 2
# Rows of a packed block: as many as make about this many bytes.
BLOCK_BYTES = 1 << 20
PACKED = "n int, block binary"


@dataclass
class FitTask:
    """Minimise ``penalty(beta) + c * sum(weight[y] * logloss)`` over the rows outside ``fold`` (all rows if None).

    The last entry of ``beta`` is the intercept. ``free`` marks the coefficients that may differ from 0.
    """

    c: float
    weights: tuple[float, float]
    l1: bool = False
    penalise_intercept: bool = True
    fold: int | None = None
    max_iter: int = 100
    free: np.ndarray | None = None
    start: np.ndarray | None = None


def pack(rows: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> DataFrame:
    """Rows as blocks ``(n, block)``: fold, label, features and a row of ones, each contiguous, ordered by fold and label."""
    columns = [(F.coalesce(F.col(fold).cast("double"), F.lit(-1.0)) if fold else F.lit(-1.0)).alias("fold"), F.col(label).cast("double").alias("y"),
               *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]]
    size = max(64, BLOCK_BYTES // (8 * (len(columns) + 1)))

    def block(rows: np.ndarray) -> pa.RecordBatch:
        rows = np.vstack([rows[:, np.lexsort((rows[1], rows[0]))], np.ones(rows.shape[1])])
        return pa.RecordBatch.from_arrays([pa.array([rows.shape[1]], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["n", "block"])

    def blocks(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(np.vstack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= size:
                rows = np.hstack(waiting)
                for start in range(0, n - n % size, size):
                    yield block(rows[:, start: start + size])
                waiting, n = [rows[:, n - n % size:]], n % size
        if n:
            yield block(np.hstack(waiting))

    return rows.select(*columns).mapInArrow(blocks, PACKED)


def is_packed(matrix: DataFrame) -> bool:
    return matrix.columns == ["n", "block"]


def unpacked(batches) -> Iterator[tuple[float, float, np.ndarray]]:
    """Fold, label, and the features over a row of ones, of each run of packed rows of one fold and label."""
    for batch in batches:
        for n, buffer in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = np.frombuffer(buffer.as_buffer()).reshape(-1, n)
            ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            for a, b in zip([0, *ends], [*ends, n]):
                yield rows[0, a], rows[1, a], rows[2:, a:b]


def packed_counts(packed: DataFrame) -> DataFrame:
    """``(fold, n, pos)`` of packed rows."""
    def counts(batches):
        found: dict[float, list[int]] = {}
        for fold, y, x in unpacked(batches):
            c = found.setdefault(fold, [0, 0])
            c[0] += x.shape[1]
            c[1] += x.shape[1] * (y == 1)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([int(f) for f in found], pa.int32()), *[pa.array([int(c[i]) for c in found.values()], pa.int64()) for i in (0, 1)]], ["fold", "n", "pos"])

    return packed.mapInArrow(counts, "fold int, n bigint, pos bigint").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def fit_many(matrix: DataFrame, features: Sequence[str], label: str, tasks: Sequence[FitTask], fold: str | None = None) -> list[np.ndarray]:
    """Coefficients (intercept last) per task; ``matrix`` has feature columns, or is packed and cached, as it is read once per step.

    Fits that end before they have converged are told of by a RuntimeWarning.
    """
    betas, converged = fit_checked(matrix, features, label, tasks, fold)
    if not all(converged):
        warnings.warn(f"{converged.count(False)} of {len(tasks)} fits ended before they had converged", RuntimeWarning, stacklevel=2)
    return betas


def fit_checked(
    matrix: DataFrame, features: Sequence[str], label: str, tasks: Sequence[FitTask], fold: str | None = None
) -> tuple[list[np.ndarray], list[bool]]:
    """As ``fit_many``, with a flag per task that says whether it converged. Works at any width; a block is the square of it."""
    d = len(features) + 1
    rows = matrix if is_packed(matrix) else pack(matrix, features, label, fold).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        states = [_State(t, d) for t in tasks]
        while any(s.running for s in states):
            active = [i for i, s in enumerate(states) if s.running]
            accepted: dict[int, bool] = {}
            for start in range(0, len(active), MAX_BLOCKS):
                part = active[start: start + MAX_BLOCKS]
                for i, (loss, grad, hess) in zip(part, _sums(rows, d, [(tasks[i], states[i].beta) for i in part])):
                    accepted[i] = states[i].accept(loss, grad, hess)
            turning = [states[i] for i in active if accepted[i]]
            proximal = [s for s in turning if s.task.l1]
            for s, step in zip(proximal, _l1_steps(proximal) if proximal else []):
                s.move(step)
            for s in turning:
                if not s.task.l1:
                    s.move(s.newton_step())
    finally:
        if rows is not matrix:
            rows.unpersist()
    return [s.best for s in states], [s.converged for s in states]


def _sums(rows: DataFrame, d: int, fits: list[tuple[FitTask, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, Hessian) of the weighted log-loss at the current coefficients of every fit, from packed rows.

    The products are made once per distinct point and run of rows of one fold and label, and then added to each fit at that
    point, with its weight of the label, unless it leaves that fold out.
    """
    shared: dict[bytes, list[int]] = {}
    for i, (_, b) in enumerate(fits):
        shared.setdefault(b.tobytes(), []).append(i)
    users = list(shared.values())
    beta = np.vstack([fits[u[0]][1] for u in users])
    weights = [t.weights for t, _ in fits]
    left_out = [None if t.fold is None else float(t.fold) for t, _ in fits]
    upper = np.triu_indices(d)
    m = len(fits)

    def reduce_partition(batches):
        loss, grad, hess = np.zeros(m), np.zeros((m, d)), np.zeros((m, d, d))
        for fold, y, x in unpacked(batches):
            one = int(y > 0.5)
            takers = [[i for i in u if left_out[i] != fold] for u in users]
            live = [p for p, u in enumerate(takers) if u]
            if not live:
                continue
            margin = beta[live] @ x
            e = np.exp(-np.abs(margin))
            losses = (np.log1p(e) + np.maximum(-margin if one else margin, 0.0)).sum(axis=1)
            slopes = (np.where(margin >= 0, 1.0, e) / (1.0 + e) - y) @ x.T
            root = np.sqrt(e) / (1.0 + e)
            for j, p in enumerate(live):
                scaled = x * root[j]
                curve = scaled @ scaled.T
                for i in takers[p]:
                    w = weights[i][one]
                    loss[i] += w * losses[j]
                    grad[i] += w * slopes[j]
                    hess[i] += w * curve
        blocks = np.column_stack([loss, grad, hess[:, upper[0], upper[1]]])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(m, dtype=np.int32)), pa.array([part] * m, pa.int32()), _lists(blocks)], ["fit", "part", "block"])

    def add(batches):
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for f, part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values):
                parts.setdefault(f, []).append((part, block))
        if parts:
            # In the order of the parts, so that the last digits do not depend on which arrived first.
            sums = np.array([np.sum([b for _, b in sorted(found, key=lambda x: x[0])], axis=0) for found in parts.values()])
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), _lists(sums)], ["fit", "block"])

    # As many partial blocks as cores ask for, not as the input has partitions; then one task adds up a fit's blocks.
    tasks = max(1, TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    partial = rows.coalesce(tasks).mapInArrow(reduce_partition, "fit int, part int, block array<double>")
    total = partial.repartition(min(len(fits), tasks), "fit").mapInArrow(add, "fit int, block array<double>").toArrow()
    blocks = np.zeros((len(fits), 1 + d + len(upper[0])))
    for f, block in zip(total.column("fit").to_pylist(), total.column("block").to_pylist()):
        blocks[f] = block  # fits x (1 + d + d (d + 1) / 2) numbers, whatever the number of rows
    out = []
    for b in blocks:
        hess = np.zeros((d, d))
        hess[upper] = b[1 + d:]
        out.append((b[0], b[1: 1 + d], hess + np.triu(hess, 1).T))
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """An Arrow list per row, from one buffer."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


class _State:
    """Damped (for L1: proximal) Newton iteration of one fit, fed with one evaluation per pass."""

    def __init__(self, task: FitTask, d: int):
        self.task, self.running, self.converged, self.passes = task, True, False, 0
        self.free = np.ones(d, bool) if task.free is None else task.free
        self.penalised = np.ones(d, bool)
        self.penalised[-1] = task.penalise_intercept
        self.beta = np.zeros(d) if task.start is None else np.where(self.free, task.start, 0.0)
        self.best, self.best_value = self.beta, np.inf
        self.step, self.slope, self.scale = np.zeros(d), 0.0, 1.0
        self.gradient, self.hessian = np.zeros(d), np.zeros((d, d))
        self.inexact = False  # the last quadratic model was not solved to its tolerance

    def penalty(self, beta: np.ndarray) -> float:
        b = beta[self.penalised]
        return float(np.abs(b).sum() if self.task.l1 else 0.5 * b @ b)

    def accept(self, loss: float, grad: np.ndarray, hess: np.ndarray) -> bool:
        """Take the evaluated point if it is good enough; otherwise go back half the way and ask for another pass."""
        self.passes += 1
        value = self.penalty(self.beta) + self.task.c * loss
        noise = 1e-12 * max(1.0, abs(value))
        if value > self.best_value + 1e-4 * self.scale * self.slope + noise:
            self.scale /= 2
            if self.scale < 1e-6 or self.passes >= self.task.max_iter:
                self.running = False  # not converged: no decrease along the step, or out of passes
            self.beta = self.best + self.scale * self.step
            return False
        self.best, self.best_value, self.scale = self.beta, value, 1.0
        self.gradient, self.hessian = self.task.c * grad, self.task.c * hess
        return True

    def move(self, step: np.ndarray) -> None:
        self.step = step
        if self.task.l1:
            self.slope = float(self.gradient @ step + self.penalty(self.best + step) - self.penalty(self.best))
        else:
            self.slope = float((self.gradient + self.penalised * self.best) @ step)
        if -self.slope <= DECREASE_TOLERANCE * max(1.0, abs(self.best_value)):
            # The step promises next to nothing; it is taken without another look at the data.
            self.best, self.running, self.converged = self.best + step, False, not self.inexact
        elif self.passes >= self.task.max_iter:
            self.running = False
        else:
            self.beta = self.best + step

    def newton_step(self) -> np.ndarray:
        ridge, keep = self.penalised.astype(float), np.flatnonzero(self.free)
        g, h = self.gradient + ridge * self.best, self.hessian + np.diag(ridge)
        step = np.zeros_like(g)
        step[keep] = -np.linalg.solve(h[np.ix_(keep, keep)] + 1e-12 * np.eye(len(keep)), g[keep])
        return step


def _l1_steps(states: list[_State]) -> list[np.ndarray]:
    """Minimise each fit's quadratic model plus L1 norm by a primal-dual interior-point iteration, all fits side by side.

    With z = p - q and p, q >= 0 the norm is linear. Unlike coordinate descent this is not slowed by collinear features.
    """
    free = np.array([s.free for s in states], float)
    hess = np.array([s.hessian for s in states]) * free[:, :, None] * free[:, None, :]
    b = np.array([s.best for s in states])
    c = np.array([s.gradient for s in states]) * free - np.einsum("mij,mj->mi", hess, b)
    # Variables and objective are scaled to order 1: unit Hessian diagonal, largest slope 1.
    unit = 1 / np.sqrt(np.maximum(np.einsum("mjj->mj", hess), 1e-12) + (1 - free))
    hess, c = hess * unit[:, :, None] * unit[:, None, :], c * unit
    size = np.maximum(np.abs(c).max(axis=1, keepdims=True), 1e-300)
    c, price = c / size, unit / size
    p, q = np.ones_like(c), np.ones_like(c)
    sp, sq = np.ones_like(c), np.ones_like(c)
    diagonal = np.arange(p.shape[1])
    solved = np.zeros(len(states), bool)
    for _ in range(INTERIOR_STEPS):
        slope = np.einsum("mij,mj->mi", hess, p - q) + c
        gap = (p * sp + q * sq).mean(axis=1, keepdims=True) / 2
        miss = np.maximum(np.abs(slope + price - sp), np.abs(price - slope - sq)).max(axis=1)
        solved = (gap[:, 0] < 1e-14) & (miss < 1e-8)
        if solved.all():
            break
        mu = np.maximum(0.1 * gap, 1e-15)  # fits that are done keep their distance from the boundary
        a1, a2 = mu / p - price - slope, mu / q - price + slope
        wp, wq = p / sp, q / sq
        system = hess.copy()
        system[:, diagonal, diagonal] += 1 / (wp + wq)
        dz = np.linalg.solve(system, ((wp * a1 - wq * a2) / (wp + wq))[:, :, None])[:, :, 0]
        turn = np.einsum("mij,mj->mi", hess, dz)
        dp, dq = wp * (a1 - turn), wq * (a2 + turn)
        dsp, dsq = (mu - sp * dp) / p - sp, (mu - sq * dq) / q - sq

        def room(x, dx):
            return np.where(dx < 0, -x / np.where(dx < 0, dx, -1.0), np.inf).min(axis=1, keepdims=True)

        primal = np.minimum(1.0, 0.99 * np.minimum(room(p, dp), room(q, dq)))
        dual = np.minimum(1.0, 0.99 * np.minimum(room(sp, dsp), room(sq, dsq)))
        both = np.minimum(primal, dual)
        p, q, sp, sq = p + both * dp, q + both * dq, sp + both * dsp, sq + both * dsq
    for s, done in zip(states, solved):
        s.inexact = not done
    # A coefficient is 0 where both halves went to the boundary, that is where neither price is used up.
    z = np.where((p < sp) & (q < sq), 0.0, p - q) * unit * size
    return [x - s.best for x, s in zip(z, states)]
