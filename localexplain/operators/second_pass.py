"""What needs the samples again once a fit is known: residual sums and whole ablation curves, in one fused pass.

The samples of wide instances are drawn, scored, predicted and summed in Arrow blocks; one row of sums leaves the task for
a fit, and no sample vector is ever a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.functions import draws
from localexplain.functions.arrow import blocks, matrix, numbers, vectors
from localexplain.operators.fit import TINY
from localexplain.operators.perturb import SAMPLES_PER_TASK_ROW, predictor, spread
from localexplain.operators.score import check_width, score_at_x0
from localexplain.sources.models import BatchModel, Model

KEYS = ("instance_id", "solver")
# s = [sum w, sum wy, sum wyy, sum w (pred - surr)^2, then sum w |curve_k - pred| for k = 0..n], y around bb_x0
HEAD = 4


def refit_sums(
    fits: DataFrame, model: Model | BatchModel, background, n_samples: int = 16384, mask_prob: float = 0.2,
    noise_std: float = 0.1, kernel_width: float = 1.0, seed: int = 1234, max_features: int = 0,
    include_intercept: bool = False, partitions: int | None = None, chunk: int = SAMPLES_PER_TASK_ROW,
) -> DataFrame:
    """(instance_id, solver, s) of every fit over the samples that it was fitted to.

    The curve starts at the surrogate's value and sets one feature after the other, the strongest first, to its sample
    mean: each step adds one product, the prediction is never computed afresh.
    """
    check_width(kernel_width)
    d, means, width = len(background), np.array(background, dtype=float), float(kernel_width) ** 2
    n = min(max_features, d)
    columns = ["instance_id", "solver", "x0", "coeff", "intercept", "x_mean"]
    ranges = spread(score_at_x0(fits.select(*columns), model), d, n_samples, partitions, chunk, KEYS)
    predict = predictor(model, fits.sparkSession, background)

    def sums_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bb, x0 = numbers(batch["instance_id"]), numbers(batch["bb_x0"]), matrix(batch["x0"])
        coeff, intercept, x_mean = matrix(batch["coeff"]), numbers(batch["intercept"]), matrix(batch["x_mean"])
        order = np.argsort(-np.abs(coeff), axis=1, kind="stable")[:, :n]
        coeff_of, mean_of = np.take_along_axis(coeff, order, 1), np.take_along_axis(x_mean, order, 1)
        at_x0 = np.einsum("md,md->m", coeff, x0)
        total = np.zeros((len(ids), HEAD + n + 1))
        for r, lo, hi in blocks(numbers(batch["first_sample"]), numbers(batch["last_sample"]), d):
            keys = draws.sample_keys(seed, ids[r], np.arange(lo, hi + 1))
            off, masked = draws.draw_offsets(keys, x0[r], means, mask_prob, noise_std)
            pred = predict(x0[r], off, masked)
            w = np.exp(-draws.squared(off) / width)
            y = pred - bb[r, None]
            start = draws.along(off, coeff[r]) + at_x0[r, None]
            miss = pred - start - intercept[r, None]
            for i, term in enumerate((w, w * y, w * y * y, w * miss * miss)):
                total[r, i] += term.sum(1)
            curve = start + intercept[r, None] if include_intercept else start
            total[r, HEAD] += (w * np.abs(curve - pred)).sum(1)
            for k in range(n):
                x = np.moveaxis(off, 2, 0)[order[r, k], np.arange(len(r))] + np.take_along_axis(x0[r], order[r, k : k + 1], 1)
                curve = curve + coeff_of[r, k, None] * (mean_of[r, k, None] - x)
                total[r, HEAD + 1 + k] += np.einsum("mb,mb->m", w, np.abs(curve - pred))
        return pa.RecordBatch.from_pydict({"instance_id": batch["instance_id"], "solver": batch["solver"], "s": vectors(total)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield sums_of(batch)

    parts = ranges.select(*columns, "bb_x0", "first_sample", "last_sample").mapInArrow(
        run, "instance_id BIGINT, solver STRING, s ARRAY<DOUBLE>"
    )
    if n_samples <= chunk:
        return parts
    size = HEAD + n + 1
    added = parts.groupBy(*KEYS).agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    return added.select(*KEYS, F.array(*[f"s{i}" for i in range(size)]).alias("s"))


def refit_r2(fits: DataFrame, model: Model | BatchModel, background, normalized: bool = False, **sampling) -> DataFrame:
    """Weighted R^2 of every fit from its samples, drawn again; the same figures and guards as ``fit.weighted_r2``."""
    sums = refit_sums(fits, model, background, **sampling)
    sw, swy, swyy, ss_res = (F.col("s")[i] for i in range(HEAD))
    total = F.greatest(sw, F.lit(TINY))
    ss_tot = swyy - swy * swy / total
    usable = (ss_tot / total if normalized else ss_tot) > TINY
    r2 = F.when(usable, F.lit(1.0) - ss_res / F.when(usable, ss_tot)).otherwise(0.0)
    return sums.select(*KEYS, r2.alias("r2"), sw.alias("sum_weights"))


def refit_curve(
    fits: DataFrame, model: Model | BatchModel, background, max_features: int = 20, include_intercept: bool = False, **sampling
) -> DataFrame:
    """(instance_id, solver, k, wmae): the ablation curve of every fit."""
    sums = refit_sums(fits, model, background, max_features=max_features, include_intercept=include_intercept, **sampling)
    points = F.posexplode(F.slice("s", HEAD + 1, F.size("s") - HEAD)).alias("k", "error")
    return sums.select(*KEYS, F.col("s")[0].alias("sw"), points).select(*KEYS, "k", F.try_divide("error", "sw").alias("wmae"))
