"""Agreement between explanations of the same instances by several sample draws, without a shuffle of fits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from localexplain.functions import arrow
from localexplain.operators import agree
from localexplain.operators.fit import Settings, Solution, System, check_solvers, solved
from localexplain.operators.moments import FLOATS_PER_BATCH, perturbed_moments
from localexplain.operators.perturb import SAMPLES_PER_TASK_ROW
from localexplain.sources.models import BatchModel, Model

PAIR = (
    "instance_id BIGINT, source_a STRING, source_b STRING, cosine DOUBLE, spearman DOUBLE, overlap DOUBLE, "
    "max_abs_delta DOUBLE, intercept_delta DOUBLE, r2_delta DOUBLE, x0_delta DOUBLE"
)


def agreement(a: Solution, b: Solution, k: int) -> dict[str, np.ndarray]:
    """The figures of ``agree.compare_pairs`` for two stacks of fits."""
    d = a.coeff.shape[1]
    norms = np.sqrt((a.coeff * a.coeff).sum(1)) * np.sqrt((b.coeff * b.coeff).sum(1))
    usable = norms > agree.TINY
    product = np.einsum("md,md->m", a.coeff, b.coeff)

    def places(c: np.ndarray) -> np.ndarray:
        order = np.argsort(np.abs(c), axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(d)[None], 1)
        return out

    def top(c: np.ndarray) -> np.ndarray:
        out = np.zeros(c.shape, bool)
        np.put_along_axis(out, np.argsort(-np.abs(c), axis=1, kind="stable")[:, :k], True, 1)
        return out

    gap = ((places(a.coeff) - places(b.coeff)).astype(float) ** 2).sum(1)
    return {
        "cosine": np.where(usable, product / np.where(usable, norms, 1.0), 0.0),
        "spearman": 1.0 - 6.0 * gap / (d * (d * d - 1.0)) if d >= 2 else np.zeros(len(gap)),
        "overlap": (top(a.coeff) & top(b.coeff)).sum(1) / float(k) if k >= 1 else np.zeros(len(gap)),
        "max_abs_delta": np.abs(a.coeff - b.coeff).max(axis=1),
        "intercept_delta": np.abs(a.intercept - b.intercept),
        "r2_delta": np.abs(a.r2 - b.r2),
        "x0_delta": np.abs(a.surr_x0 - b.surr_x0),
    }


def compare_seeds(
    instances: DataFrame, model: Model | BatchModel, background, seeds: Mapping[str, int], k: int = 10,
    n_samples: int = 16384, mask_prob: float = 0.2, noise_std: float = 0.1, kernel_width: float = 1.0,
    solver: str = "cholesky", partitions: int | None = None, chunk: int = SAMPLES_PER_TASK_ROW, **settings,
) -> DataFrame:
    """All pairs of the named seeds, in their order: how alike the explanations of each instance are.

    The sums of all seeds are made in the task of their instance, solved there together and compared there.
    """
    if len(seeds) < 2:
        raise ValueError(f"a comparison takes two sources or more, not {len(seeds)}")
    (name,), names, options = check_solvers(solver), list(seeds), Settings(**settings)
    sums = perturbed_moments(
        instances, model, background, n_samples, mask_prob, noise_std, kernel_width, list(seeds.values()), partitions, chunk
    )
    d = len(background)

    def pairs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x0, bb = arrow.matrix(batch["x0"]), arrow.numbers(batch["bb_x0"])
        s = arrow.matrix(batch["s"]).reshape(len(batch), len(names), -1)
        fits = [solved(System(s[:, i], bb, d), x0, name, options) for i in range(len(names))]
        for i, j in combinations(range(len(names)), 2):
            columns = {"instance_id": batch["instance_id"]}
            for field, source in (("source_a", names[i]), ("source_b", names[j])):
                columns[field] = pa.array([source] * len(batch), pa.string())
            columns |= {field: pa.array(v) for field, v in agreement(fits[i], fits[j], k).items()}
            yield pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, FLOATS_PER_BATCH // (len(names) * (d + 1) ** 2))
        for batch in batches:
            for at in range(0, len(batch), step):
                yield from pairs_of(batch.slice(at, step))

    return sums.select("instance_id", "x0", "bb_x0", "s").mapInArrow(run, PAIR)
