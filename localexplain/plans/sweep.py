"""Sweeps of the explanation over a (D, B, run) grid, from one pass over the instances.

A run is a seed; its samples are drawn once, for the largest D and B.  The first D features of a sample are a sample of D
features, and the first B samples are those of a smaller B, so every D adds its own sums of the same draws and every B is
a running sum over sample segments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.functions import draws
from localexplain.functions.arrow import blocks, matrix, numbers
from localexplain.operators.fit import Settings, System, check_solvers, solved
from localexplain.operators.moments import FLOATS_PER_BATCH, MERGE_SALTS, block_sums, size_of
from localexplain.operators.perturb import SAMPLES_PER_TASK_ROW, spread
from localexplain.operators.score import check_width
from localexplain.sources.models import Model

POINT = "D INT, B INT, run INT, n BIGINT, r2 DOUBLE, delta DOUBLE"
PART = "instance_id BIGINT, D INT, run INT, segment INT, salt INT, x0 ARRAY<DOUBLE>, s ARRAY<DOUBLE>"
KEYS = ["instance_id", "D", "run"]


def sweep_fidelity(
    instances: DataFrame, model: Model, background, d_values: Sequence[int], b_values: Sequence[int], runs: int,
    seed: int = 1234, mask_prob: float = 0.2, noise_std: float = 0.1, kernel_width: float = 1.0, solver: str = "cholesky",
    ridge: float = 1e-3, gd_iters: int = 500, gd_lr: float = 1e-2, epochs: int = 300, adam_lr: float = 0.01,
    partitions: int | None = None, chunk: int = SAMPLES_PER_TASK_ROW,
) -> DataFrame:
    """Mean R^2 and mean |surrogate - black box| at x0 for every (D, B, run).

    D keeps the first D features of instance, model and background; run r uses seed + r.  Every point of the grid has a
    row, with null means and n = 0 where there is no instance.
    """
    check_width(kernel_width)
    (name,) = check_solvers(solver)
    ds, bs = sorted(set(d_values)), sorted(set(b_values))
    if not ds or not bs or runs < 1 or ds[0] < 1 or bs[0] < 1:
        raise ValueError("a sweep needs at least one D, one B and one run")
    d_max, settings = ds[-1], Settings(ridge, gd_iters, gd_lr, epochs, adam_lr)
    if d_max > len(background):
        raise ValueError(f"D = {d_max} is beyond the {len(background)} features of the background")
    means, w, bias = np.array(background[:d_max], float), np.array(model.w[:d_max]), float(model.bias)
    ends = np.array(bs)
    cut = instances.select("instance_id", F.slice("x0", 1, d_max).alias("x0"))
    ranges = spread(cut, d_max, bs[-1], partitions, chunk)

    def at_x0(x0: np.ndarray, d: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(x0[:, :d] @ w[:d] + bias)))

    def drawn(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(ids, x0, run, {D: sums by row and segment}) of the rows of a batch."""
        row = len(bs) * sum(map(size_of, ds))
        for at in range(0, len(batch), max(1, FLOATS_PER_BATCH // row)):
            part = batch.slice(at, max(1, FLOATS_PER_BATCH // row))
            ids, x0 = numbers(part["instance_id"]), matrix(part["x0"])
            first, last = numbers(part["first_sample"]), numbers(part["last_sample"])
            for run in range(1, runs + 1):
                sums = {d: np.zeros((len(ids), len(bs), size_of(d))) for d in ds}
                for g, end in enumerate(bs):
                    lows, highs = np.maximum(first, bs[g - 1] if g else 0), np.minimum(last, end - 1)
                    inside = np.flatnonzero(lows <= highs)
                    for r, lo, hi in blocks(lows[inside], highs[inside], d_max):
                        r = inside[r]
                        keys = draws.sample_keys(seed + run, ids[r], np.arange(lo, hi + 1))
                        off, _ = draws.draw_offsets(keys, x0[r], means, mask_prob, noise_std)
                        for d in ds:
                            part_off = off[..., :d]
                            logit = (x0[r, :d] @ w[:d] + bias)[:, None] + draws.along(part_off, w[:d])
                            y = 1.0 / (1.0 + np.exp(-logit)) - at_x0(x0[r], d)[:, None]
                            weight = np.exp(-draws.squared(part_off) / kernel_width**2)
                            sums[d][r, g] += block_sums(part_off, weight, y)
                yield ids, x0, run, sums, first

    def points(x0: np.ndarray, d: int, s: np.ndarray) -> tuple[int, float, float]:
        """(n, sum of R^2, sum of deltas) of a stack of whole sums."""
        bb = at_x0(x0, d)
        n, r2, delta, step = len(x0), 0.0, 0.0, max(1, FLOATS_PER_BATCH // (d + 1) ** 2)
        for at in range(0, n, step):
            cut_ = slice(at, at + step)
            found = solved(System(s[cut_], bb[cut_], d), x0[cut_, :d], name, settings)
            r2, delta = r2 + found.r2.sum(), delta + np.abs(found.surr_x0 - bb[cut_]).sum()
        return n, r2, delta

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, x0, run, sums, _ in drawn(batch):
                for d in ds:
                    running = np.cumsum(sums[d], axis=1)
                    rows += [(d, b, run, *points(x0, d, running[:, g])) for g, b in enumerate(bs)]
            yield _batch(rows, POINT)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x0, run, sums, first in drawn(batch):
                for d in ds:
                    for i, g in product(range(len(ids)), range(len(bs))):
                        if sums[d][i, g, 0]:
                            salt = int(first[i] // chunk % MERGE_SALTS)
                            yield _batch([(int(ids[i]), d, run, g, salt, x0[i, :d], sums[d][i, g])], PART)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x0, s in _added(batches, 5):
            yield _batch([(*key, x0, s)], PART)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for key, x0, s in _added(batches, 4):
            total = total + s if key[:3] == held else s
            held = key[:3]
            yield _batch([(key[1], bs[key[3]], key[2], *points(x0[None], key[1], total[None]))], POINT)

    source = ranges.select("instance_id", "x0", "first_sample", "last_sample")
    if ends[-1] <= chunk:
        found = source.mapInArrow(whole, POINT)
    else:
        # Sums of sample ranges meet in two steps, so that no task has all ranges of an instance.
        order = [*KEYS, "segment"]
        parts = source.mapInArrow(partial, PART).repartition(*order, "salt").sortWithinPartitions(*order, "salt").mapInArrow(merge, PART)
        found = parts.repartition(*KEYS).sortWithinPartitions(*order).mapInArrow(running, POINT)
    grid = instances.sparkSession.createDataFrame(
        [(d, b, r, 0, 0.0, 0.0) for d in ds for b in bs for r in range(1, runs + 1)], POINT
    )
    total = found.unionAll(grid).groupBy("D", "B", "run").agg(F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.sum("delta").alias("delta"))
    return total.select(
        "D", "B", "run", F.try_divide("r2", "n").alias("mean_r2"), F.try_divide("delta", "n").alias("mean_delta"), "n"
    )


_KINDS = {"INT": pa.int32(), "BIGINT": pa.int64(), "DOUBLE": pa.float64(), "ARRAY<DOUBLE>": pa.list_(pa.float64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[f for f, _ in fields])


def _added(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple]:
    """(key, x0, s) for rows in order of their first n_keys columns, s added up over equal keys."""
    held = None
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)))
        for key, x0, s in zip(keys, batch["x0"], batch["s"]):
            x0, s = x0.values.to_numpy(), s.values.to_numpy()
            if held is not None and held[0] == key:
                held = (key, x0, held[2] + s)
                continue
            if held is not None:
                yield held
            held = (key, x0, s)
    if held is not None:
        yield held
