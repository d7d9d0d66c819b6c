"""Surrogate fits from moments: Cholesky, gradient descent or Adam, R^2 and fidelity at x0.

One moments row is one instance, so fits run in parallel over instances without a shuffle.  A task
solves the instances of an Arrow batch together, as stacked matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localexplain import schemas
from localexplain.functions import arrow, vectors
from localexplain.operators.moments import HEAD, Then

SOLVERS = ("cholesky", "gd", "adam")
STD_EPS = 1e-8
TINY = 1e-12
# Below this share of the squared offset a variance is rounding noise: the feature is constant.
CONSTANT = 1e-13
FLOATS_PER_STACK = 1 << 20
# Stacked products of tiny matrices are four times faster as one einsum than as a call per matrix.
SMALL_SYSTEM = 16


def check_solvers(solver: str | Sequence[str]) -> tuple[str, ...]:
    names = (solver,) if isinstance(solver, str) else tuple(solver)
    for name in names:
        if name not in SOLVERS:
            raise ValueError(f"{name!r} is no solver; use {' or '.join(SOLVERS)}")
    return names


class System:
    """Normal equations of a stack of instances in z-scored features, intercept first."""

    def __init__(self, s: np.ndarray, y0: np.ndarray, d: int):
        n, self.sw, swy, swyy = s[:, :HEAD].T
        sd, sdd, swd, swdy = (s[:, HEAD + i * d : HEAD + (i + 1) * d] for i in range(4))
        rows, cols = np.triu_indices(d)
        gram = np.empty((len(s), d, d))
        gram[:, rows, cols] = gram[:, cols, rows] = s[:, HEAD + 4 * d :]
        self.n, self.y0 = n, y0
        self.shift = sd / n[:, None]
        raw = sdd / n[:, None]
        var = np.maximum(raw - self.shift**2, 0.0)
        constant = var <= CONSTANT * raw
        self.std = np.sqrt(np.where(constant, 0.0, var)) + STD_EPS
        m, sw = self.shift, self.sw[:, None]
        scale = np.where(constant, 0.0, 1.0 / self.std)
        self.A = np.zeros((len(s), d + 1, d + 1))
        self.A[:, 0, 0] = self.sw
        self.A[:, 0, 1:] = self.A[:, 1:, 0] = (swd - m * sw) * scale
        cross = m[:, :, None] * swd[:, None, :]
        centred = gram - cross - cross.transpose(0, 2, 1) + m[:, :, None] * m[:, None, :] * sw[:, None]
        self.A[:, 1:, 1:] = centred * scale[:, :, None] * scale[:, None, :]
        self.b_centred = np.concatenate([swy[:, None], (swdy - m * swy[:, None]) * scale], axis=1)
        # the ridge also holds the intercept, so the fit must see the uncentred scores
        self.b = self.b_centred + y0[:, None] * self.A[:, 0]
        self.swy, self.swyy = swy, swyy

    def cholesky(self, ridge: float, pivot_floor: float) -> np.ndarray:
        size = self.A.shape[1]
        a = self.A + ridge * np.eye(size)
        low = np.zeros_like(a)
        for k in range(size):
            known = low[:, k:, :k]
            column = a[:, k:, k] - np.einsum("mij,mj->mi", known, known[:, 0])
            pivot = np.sqrt(np.maximum(column[:, :1], pivot_floor))
            low[:, k:, k] = column / pivot
            low[:, k, k] = pivot[:, 0]
        beta = self.b.copy()
        for k in range(size):
            beta[:, k] = (beta[:, k] - np.einsum("mj,mj->m", low[:, k, :k], beta[:, :k])) / low[:, k, k]
        for k in reversed(range(size)):
            beta[:, k] = (
                beta[:, k] - np.einsum("mj,mj->m", low[:, k + 1 :, k], beta[:, k + 1 :])
            ) / low[:, k, k]
        return beta

    def _apply(self, beta):
        if beta.shape[1] <= SMALL_SYSTEM:
            return np.einsum("mij,mj->mi", self.A, beta)
        return np.matmul(self.A, beta[..., None])[..., 0]

    def descend(self, ridge: float, iters: int, lr: float, rows: np.ndarray | None = None) -> np.ndarray:
        """``iters`` gradient steps from 0, of the given rows only.

        Each step shrinks the error along an eigenvector of A + ridge I by one factor, so the steps
        have a closed form: beta = V ((1 - (1 - step v)^iters) / v) V' b.  A system that holds values which are not
        finite has no finite result either way.
        """
        rows = np.arange(len(self.b)) if rows is None else rows
        a, b = self.A[rows], self.b[rows]
        step = lr / np.maximum(self.sw[rows], TINY)
        usable = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1)
        beta = np.full_like(b, np.nan)
        if usable.any():
            values, vectors_ = np.linalg.eigh(a[usable])
            values = np.maximum(values, 0.0) + ridge
            reach = step[usable, None] * values
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                # -expm1(n log1p(-r)) loses no digits where r is tiny; beyond r = 1 the factor changes sign.
                shrunk = np.where(reach < 1, -np.expm1(iters * np.log1p(-np.minimum(reach, 1 - 1e-16))), 1 - (1 - reach) ** iters)
                gain = np.where(values > 0, shrunk / np.where(values > 0, values, 1.0), iters * step[usable, None])
                turned = np.einsum("mji,mj->mi", vectors_, b[usable])
                beta[usable] = np.einsum("mij,mj->mi", vectors_, np.where(turned == 0, 0.0, gain * turned))
        return beta

    def descend_by_steps(self, ridge: float, iters: int, lr: float) -> np.ndarray:
        """The steps themselves: what ``descend`` must equal."""
        beta = np.zeros_like(self.b)
        step = (lr / np.maximum(self.sw, TINY))[:, None]
        for _ in range(iters):
            beta -= step * (self._apply(beta) - self.b + ridge * beta)
        return beta

    def adam(self, epochs: int, lr: float) -> tuple[np.ndarray, np.ndarray]:
        beta, first, second = (np.zeros_like(self.b) for _ in range(3))
        total = np.maximum(self.sw, TINY)
        loss = np.empty((len(beta), epochs))
        # Fixed values of Adam: decay rates 0.9 and 0.999, epsilon 1e-8.
        for t in range(1, epochs + 1):
            residual = self._apply(beta) - self.b
            loss[:, t - 1] = self.ss_res(beta) / total
            grad = 2.0 * residual / total[:, None]
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            beta = beta - lr * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return beta, loss

    def ss_res(self, beta: np.ndarray) -> np.ndarray:
        c = beta.copy()
        c[:, 0] -= self.y0
        fitted = np.einsum("mi,mi->m", c, self._apply(c) - 2.0 * self.b_centred)
        return np.maximum(self.swyy + fitted, 0.0)

    def r2(self, beta: np.ndarray, normalized: bool) -> np.ndarray:
        total = np.maximum(self.sw, TINY)
        ss_tot = self.swyy - self.swy**2 / total
        usable = (ss_tot / total if normalized else ss_tot) > TINY
        return np.where(usable, 1.0 - self.ss_res(beta) / np.where(usable, ss_tot, 1.0), 0.0)


@dataclass(frozen=True)
class Settings:
    """What a solver is told besides the system."""

    ridge: float = 1e-3
    gd_iters: int = 500
    gd_lr: float = 1e-2
    epochs: int = 300
    adam_lr: float = 0.01
    pivot_floor: float = 1e-24


@dataclass
class Solution:
    """Fits of a stack of instances: arrays with one row for each."""

    used: np.ndarray
    iters: np.ndarray
    coeff: np.ndarray
    intercept: np.ndarray
    surr_x0: np.ndarray
    r2: np.ndarray
    loss: np.ndarray | None = None


def solved(system: System, x0: np.ndarray, name: str, settings: Settings) -> Solution:
    """The stack's fits by one solver; a closed form that is not finite is repeated by gradient descent."""
    used = np.full(len(x0), name, dtype=object)
    iters, loss = np.zeros(len(x0), np.int32), None
    if name == "adam":
        beta, loss = system.adam(settings.epochs, settings.adam_lr)
        iters[:] = settings.epochs
    elif name == "gd":
        beta = system.descend(settings.ridge, settings.gd_iters, settings.gd_lr)
        iters[:] = settings.gd_iters
    else:
        beta = system.cholesky(settings.ridge, settings.pivot_floor)
        failed = ~np.isfinite(beta).all(axis=1)
        if failed.any():
            beta[failed] = system.descend(settings.ridge, settings.gd_iters, settings.gd_lr, np.flatnonzero(failed))
            used[failed], iters[failed] = "gd", settings.gd_iters
    coeff = beta[:, 1:] / system.std
    intercept = beta[:, 0] - (coeff * (x0 + system.shift)).sum(1)
    surr_x0 = beta[:, 0] - (coeff * system.shift).sum(1)
    return Solution(used, iters, coeff, intercept, surr_x0, system.r2(beta, normalized=name == "adam"), loss)


def fit(
    moments: DataFrame,
    solver: str | Sequence[str] = "cholesky",
    ridge: float = 1e-3,
    gd_iters: int = 500,
    gd_lr: float = 1e-2,
    epochs: int = 300,
    adam_lr: float = 0.01,
    pivot_floor: float = 1e-24,
) -> DataFrame:
    """One row per instance and solver (``schemas.FITS``).

    A closed-form fit with a non-finite coefficient is repeated by gradient descent and reported as
    ``gd``.  Several solvers share one pass over the moments.
    """
    runs = [("", name, Settings(ridge, gd_iters, gd_lr, epochs, adam_lr, pivot_floor)) for name in check_solvers(solver)]
    return moments.select("instance_id", "x0", "bb_x0", "s").mapInArrow(*solving(runs))


def fitting(
    solver: str | Sequence[str] = "cholesky", ridge: float = 1e-3, gd_iters: int = 500, gd_lr: float = 1e-2,
    epochs: int = 300, adam_lr: float = 0.01,
) -> Then:
    """``fit`` for ``perturbed_moments(then=...)``: the sums are solved where they are made."""
    return solving([("", name, Settings(ridge, gd_iters, gd_lr, epochs, adam_lr)) for name in check_solvers(solver)])


def fit_sources(moments: DataFrame, sources: Mapping[str, Mapping]) -> DataFrame:
    """The fits of several sources under one roof, as ``load_fits`` has them: ``source`` -> arguments of ``fit``.

    All share one pass over the moments, which are most of the work.
    """
    runs = []
    for source, arguments in sources.items():
        settings = dict(arguments)
        solvers = check_solvers(settings.pop("solver", "cholesky"))
        runs += [(source, name, Settings(**settings)) for name in solvers]
    if not runs:
        raise ValueError("no source given")
    return moments.select("instance_id", "x0", "bb_x0", "s").mapInArrow(*solving(runs, schemas.FITS + ", source STRING"))


def solving(runs: Sequence[tuple[str, str, Settings]], schema: str = schemas.FITS) -> Then:
    """From batches of moments to fits for every (source, solver, settings), and the schema of these."""
    tagged = schema != schemas.FITS

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            size = len(batch["x0"][0])
            step = max(1, FLOATS_PER_STACK // (size + 1) ** 2)
            for at in range(0, len(batch), step):
                yield from solve_stack(batch.slice(at, step), size)

    def solve_stack(batch: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
        x0 = arrow.matrix(batch["x0"])
        bb = arrow.numbers(batch["bb_x0"])
        system = System(arrow.matrix(batch["s"]), bb, d)
        mean = x0 + system.shift
        for source, name, settings in runs:
            found = solved(system, x0, name, settings)
            columns = {
                "instance_id": batch["instance_id"],
                "solver": pa.array(found.used, pa.string()),
                "ridge": pa.array(np.full(len(bb), 0.0 if name == "adam" else float(settings.ridge))),
                "coeff": arrow.vectors(found.coeff),
                "intercept": pa.array(found.intercept),
                "surr_x0": pa.array(found.surr_x0),
                "bb_x0": pa.array(bb),
                "r2": pa.array(found.r2),
                "num_iters": pa.array(found.iters),
                "n_samples": pa.array(system.n.astype(np.int64)),
                "sum_weights": pa.array(system.sw),
                "x0": batch["x0"],
                "x_mean": arrow.vectors(mean),
                "loss": pa.nulls(len(bb), pa.list_(pa.float64())) if found.loss is None else arrow.vectors(found.loss),
            }
            if tagged:
                columns["source"] = pa.array([source] * len(bb), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return solve, schema


def normal_equations(moments: DataFrame, ridge: float = 0.0) -> DataFrame:
    """The z-scored system in long form: (instance_id, i, j, a) with i <= j and, for j = -1, the rhs."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d = len(batch["x0"][0])
            step = max(1, FLOATS_PER_STACK // (d + 1) ** 2)
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                system = System(arrow.matrix(part["s"]), arrow.numbers(part["bb_x0"]), d)
                rows, cols = np.triu_indices(d + 1)
                a = (system.A + ridge * np.eye(d + 1))[:, rows, cols]
                i = np.concatenate([rows, np.arange(d + 1)])
                j = np.concatenate([cols, np.full(d + 1, -1)])
                values = np.concatenate([a, system.b], axis=1)
                ids = arrow.numbers(part["instance_id"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "instance_id": pa.array(np.repeat(ids, len(i))),
                        "i": pa.array(np.tile(i, len(ids)).astype(np.int32)),
                        "j": pa.array(np.tile(j, len(ids)).astype(np.int32)),
                        "value": pa.array(values.ravel()),
                    }
                )

    return moments.select("instance_id", "x0", "bb_x0", "s").mapInArrow(
        entries, "instance_id BIGINT, i INT, j INT, value DOUBLE"
    )


# --- row-wise use of a fit --------------------------------------------------------------------


def surrogate_predict(rows: DataFrame, vec: str = "x") -> DataFrame:
    """Add ``surr``, the surrogate value at ``vec``; rows carry ``coeff`` and ``intercept``."""
    return rows.withColumn("surr", vectors.dot(F.col("coeff"), F.col(vec)) + F.col("intercept"))


def local_delta() -> Column:
    return F.abs(F.col("surr_x0") - F.col("bb_x0"))


def weighted_r2(predicted: DataFrame, keys: Sequence[str] = ("instance_id",), normalized: bool = False) -> DataFrame:
    """R^2 of ``surr`` against ``pred`` under ``weight`` from the samples themselves.

    0 where the weighted total sum of squares is at most 1e-12 (``normalized``: after dividing by
    the sum of weights).  Sums are taken around ``bb_x0`` where the rows carry it.
    """
    y = F.col("pred") - (F.col("bb_x0") if "bb_x0" in predicted.columns else F.lit(0.0))
    miss = F.col("pred") - F.col("surr")
    sums = predicted.groupBy(*keys).agg(
        F.sum("weight").alias("sw"),
        F.sum(F.col("weight") * y).alias("swy"),
        F.sum(F.col("weight") * y * y).alias("swyy"),
        F.sum(F.col("weight") * miss * miss).alias("ss_res"),
    )
    total = F.greatest(F.col("sw"), F.lit(TINY))
    ss_tot = F.col("swyy") - F.col("swy") * F.col("swy") / total
    usable = (ss_tot / total if normalized else ss_tot) > TINY
    # the divisor is guarded as well: ANSI division checks it before the branch is taken
    r2 = F.when(usable, F.lit(1.0) - F.col("ss_res") / F.when(usable, ss_tot)).otherwise(0.0)
    return sums.select(*keys, r2.alias("r2"), F.col("sw").alias("sum_weights"))
