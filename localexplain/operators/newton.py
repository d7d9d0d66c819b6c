"""Training of the logistic black box by Newton's method on weighted Gram matrices.

One pass over the rows gives the loss, its gradient and its Hessian at a point: sums of the kind of ``moments``, with
p (1 - p) as the weight of a row.  They are added up where the rows are, so a pass moves D + 1 short rows per task whatever
the number of rows is, and a handful of passes is all that is needed.  The driver holds one system of D + 1 equations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.functions import arrow
from localexplain.functions.draws import double

UNROLLED = 8
ROWS_PER_BLOCK = 1 << 13
HALVINGS = 30


@dataclass
class Sums:
    """Loss, gradient and Hessian of the unpenalised loss at one point; the intercept comes first."""

    n: int
    positives: int
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray


def checked(train: DataFrame, d: int) -> DataFrame:
    """(x, y) with an error for a label other than 0 and 1 and for a vector that does not hold d finite values."""
    bad = (
        f"x IS NULL OR size(x) <> {d} OR exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity')) "
        "OR label IS NULL OR label NOT IN (0, 1)"
    )
    message = f"concat('a training row needs {d} finite values and a label 0 or 1, not label ', coalesce(string(label), 'NULL'))"
    vector = f"CASE WHEN {bad} THEN raise_error({message}) ELSE x END"
    return train.selectExpr("transform(x, v -> double(v)) AS x", "label").selectExpr(f"{vector} AS x", "double(label) AS y")


def _narrow(rows: DataFrame, beta: np.ndarray) -> Sums:
    """All sums as columns of generated code."""
    d = len(beta) - 1
    x = ["1D", *[f"x{i}" for i in range(d)]]
    z = " + ".join(f"{double(b)} * {c}" for b, c in zip(beta, x))
    df = rows.selectExpr("y", *[f"x[{i}] AS x{i}" for i in range(d)]).selectExpr("*", f"{z} AS z")
    df = df.selectExpr("*", "1D / (1D + exp(-z)) AS p").selectExpr("*", "p - y AS e", "p * (1D - p) AS w")
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"),
        F.expr("sum(greatest(z, 0D) - y * z + log1p(exp(-abs(z))))").alias("loss"),
        *[F.expr(f"sum(e * {c})").alias(f"g{i}") for i, c in enumerate(x)],
        *[F.expr(f"sum(w * {x[i]} * {x[j]})").alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    if not sums.n:
        return Sums(0, 0, 0.0, np.zeros(d + 1), np.zeros((d + 1, d + 1)))
    hessian = np.zeros((d + 1, d + 1))
    for i, j in pairs:
        hessian[i, j] = hessian[j, i] = sums[f"h{i}_{j}"]
    return Sums(sums.n, int(sums.positives), sums.loss, np.array([sums[f"g{i}"] for i in range(d + 1)]), hessian)


def _wide(rows: DataFrame, beta: np.ndarray) -> Sums:
    """Row i of the Hessian with entry i of the gradient from each task, added up by i; row 0 carries the counts as well."""
    size = len(beta)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 4))
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BLOCK):
                part = batch.slice(at, ROWS_PER_BLOCK)
                x = np.concatenate((np.ones((len(part), 1)), arrow.matrix(part["x"])), axis=1)
                y = arrow.numbers(part["y"])
                z = x @ beta
                p = 0.5 * (1 + np.tanh(0.5 * z))
                total[:, :size] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, size] += (p - y) @ x
                loss = np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z)))
                total[0, size + 1 :] += len(part), y.sum(), loss.sum()
        if total[0, size + 1]:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size, dtype=np.int32)), "s": arrow.vectors(total)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # at most size rows: the system's
        for batch in batches:
            for i, s in zip(batch["i"].to_pylist(), arrow.matrix(batch["s"]) if len(batch) else ()):
                held[i] = held[i] + s if i in held else s
        if held:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(held), pa.int32()), "s": arrow.vectors(np.stack(list(held.values())))})

    schema = "i INT, s ARRAY<DOUBLE>"
    parts = rows.mapInArrow(sums, schema).repartition("i").mapInArrow(add, schema)
    found = {r.i: r.s for r in parts.collect()}  # D + 1 rows of D + 5 numbers
    if not found:
        return Sums(0, 0, 0.0, np.zeros(size), np.zeros((size, size)))
    total = np.array([found[i] for i in range(size)])
    n, positives, loss = total[0, size + 1 :]
    return Sums(int(n), int(positives), float(loss), total[:, size], (total[:, :size] + total[:, :size].T) / 2)


def newton_sums(rows: DataFrame, beta: np.ndarray) -> Sums:
    """One pass over (x, y) at ``beta``."""
    return (_narrow if len(beta) <= UNROLLED + 1 else _wide)(rows, beta)


def train_logistic(train: DataFrame, d: int, c: float = 1.0, max_iter: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, int]:
    """(intercept and weights, passes) that minimise c * sum of losses + |w|^2 / 2 over (x ARRAY, label).

    The intercept is not penalised.  A step that does not lower the objective is halved.  Both classes must occur.
    Rows with a null or non-finite value or another label are an error.
    """
    ridge = np.full(d + 1, 1.0 / c)
    ridge[0] = 0.0
    # Read once per pass; partitions that do not fit, or are lost, come from disk or are made again.
    rows = checked(train, d).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beta, best, step, passes = np.zeros(d + 1), np.inf, np.zeros(d + 1), 0
        halved = 0
        while passes < max_iter:
            here = newton_sums(rows, beta + step)
            passes += 1
            if here.n == 0:
                raise ValueError("no training rows")
            if here.positives in (0, here.n):
                raise ValueError("the training rows hold one class only")
            penalty = 0.5 * float(ridge @ (beta + step) ** 2)
            if not here.loss + penalty <= best + 1e-12 * abs(best) and halved < HALVINGS:
                step, halved = step / 2, halved + 1
                continue
            beta, best, halved = beta + step, here.loss + penalty, 0
            step = -np.linalg.solve(here.hessian + np.diag(ridge), here.gradient + ridge * beta)
            if np.abs(step).max() <= tol * max(1.0, np.abs(beta).max()):
                return beta + step, passes
        return beta, passes
    finally:
        rows.unpersist()
