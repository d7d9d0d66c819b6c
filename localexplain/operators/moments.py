"""Weighted sums of the surrogate fit: one small vector per instance replaces its B samples.

With ``d = x - x0`` and ``y = pred - bb_x0`` every instance keeps

    s = [n, sum w, sum wy, sum wyy | sum d | sum dd | sum wd | sum wdy | upper triangle of sum w d d']

from which means, deviations, the z-scored weighted Gram matrix, its right-hand side and the residual
sum of squares all follow (``fit``).  The shift by the instance and its own score keeps the sums
small, so nothing is lost by making a single pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.functions import draws
from localexplain.functions.arrow import blocks, matrix, numbers, vectors
from localexplain.functions.draws import double
from localexplain.functions.sizes import salt_of, salted_join
from localexplain.operators.perturb import SAMPLES_PER_TASK_ROW, predictor, range_size, spread
from localexplain.operators.score import check_width, score_at_x0
from localexplain.sources.models import BatchModel, Model

# Up to here the sums of stored samples, and sums that are wanted as such, are columns in generated code; beyond, their number
# grows as D^2 / 2 and the generated methods pass the JIT limit, so NumPy forms the Gram matrix of each Arrow batch.
UNROLLED_GRAM = 8
FLOATS_PER_BATCH = 1 << 20
MERGE_SALTS = 64
REPLAY_SALTS = 16
HEAD = 4
Then = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def size_of(d: int) -> int:
    return HEAD + 4 * d + d * (d + 1) // 2


def rows_per_batch(d: int) -> int:
    """Rows of ``s`` in one Arrow batch, so that a batch stays near 8 MB whatever D is."""
    return max(1, FLOATS_PER_BATCH // size_of(d))


def _sums(d: int, off: list[str], w: str, y: str) -> list[str]:
    """SQL of the entries of ``s`` given column names; w*d_i, w*y and the like are shared."""
    return (
        ["double(count(*))", f"sum({w})", "sum(wy)", f"sum(wy * {y})"]
        + [f"sum({o})" for o in off]
        + [f"sum({o} * {o})" for o in off]
        + [f"sum(w{o})" for o in off]
        + [f"sum(w{o} * {y})" for o in off]
        + [f"sum(w{off[i]} * {off[j]})" for i in range(d) for j in range(i, d)]
    )


def _grouped(df: DataFrame, d: int, off: list[str], base: list[str], keys: tuple[str, ...] = ("instance_id",)) -> DataFrame:
    df = df.selectExpr(
        *keys, *base, "bb_x0", *off, "weight", "y",
        *[f"weight * {o} AS w{o}" for o in off], "weight * y AS wy",
    )
    named = [f"{e} AS s{i}" for i, e in enumerate(_sums(d, off, "weight", "y"))]
    carried = [f"max({b}) AS {b}" for b in [*base, "bb_x0"]]
    return (
        df.groupBy(*keys)
        .agg(*[F.expr(e) for e in carried + named])
        .selectExpr(
            *keys,
            f"array({', '.join(base)}) AS x0",
            "bb_x0",
            f"array({', '.join(f's{i}' for i in range(len(named)))}) AS s",
        )
    )


def perturbed_moments(
    instances: DataFrame, model: Model | BatchModel, background, n_samples: int, mask_prob: float, noise_std: float,
    kernel_width: float, seed: int | Sequence[int], partitions: int | None = None, chunk: int = SAMPLES_PER_TASK_ROW,
    then: Then | None = None,
) -> DataFrame:
    """Moments of the samples that ``perturb`` would make, without writing any sample down.

    ``then``, a function on batches of moments and the schema of its rows, runs where the sums are made, so they
    need not leave the Python worker.  Without it the sums of narrow samples never enter one.

    Several seeds give several sets of samples of every instance: ``s`` then holds their sums one after the other.
    """
    check_width(kernel_width)
    d = len(background)
    if d != model.d:
        raise ValueError(f"the model has {model.d} features, the background {d}")
    generated = then is None and d <= UNROLLED_GRAM and isinstance(model, Model) and isinstance(seed, int)
    if not generated:  # the narrow sums of a range are as few bytes as its instance
        chunk = range_size(instances, n_samples, chunk, partitions)
    df = score_at_x0(spread(instances, d, n_samples, partitions, chunk), model)
    if generated:
        return _generated(df, model, background, mask_prob, noise_std, kernel_width, seed)
    return _blocked(df, model, background, n_samples, mask_prob, noise_std, kernel_width, seed, chunk, then)


def _generated(df, model: Model, background, mask_prob, noise_std, kernel_width, seed: int) -> DataFrame:
    d = len(background)
    base, off = [f"b{f}" for f in range(d)], [f"d{f}" for f in range(d)]
    # coalesce marks the columns as never null, which halves the generated code
    df = df.selectExpr(
        "instance_id",
        *[f"coalesce(x0[{f}], 0D) AS {b}" for f, b in enumerate(base)],
        "coalesce(bb_x0, 0D) AS bb_x0", "first_sample", "last_sample",
    ).selectExpr(
        "*", " + ".join([double(model.bias), *[f"{double(w)} * {b}" for w, b in zip(model.w, base)]]) + " AS logit0"
    ).selectExpr(
        "* EXCEPT (first_sample, last_sample)", "explode(sequence(first_sample, last_sample)) AS sample_id"
    ).selectExpr("* EXCEPT (sample_id)", f"{draws.sample_key(seed)} AS sample_key")
    cells = [
        f"if({draws.mask_test('sample_key', draws.mask_word(f), mask_prob)}, {double(m)} - {base[f]}, "
        f"{double(noise_std)} * {draws.normal(f)}) AS {off[f]}"
        for f, m in enumerate(background)
    ]
    df = df.selectExpr("*", *draws.pair_columns(d)).selectExpr("instance_id", *base, "bb_x0", "logit0", *cells).selectExpr(
        "* EXCEPT (logit0)",
        f"exp(({' + '.join(f'{o} * {o}' for o in off)}) * {double(-1 / kernel_width**2)}) AS weight",
        "logit0 + " + " + ".join(f"{double(w)} * {o}" for w, o in zip(model.w, off)) + " AS logit",
    ).selectExpr("* EXCEPT (logit)", "coalesce(1D / (1D + exp(-logit)), 0D) - bb_x0 AS y")
    return _grouped(df, d, off, base)


def sample_moments(samples: DataFrame, d: int, in_runs: bool = False) -> DataFrame:
    """Moments of scored, weighted samples (instance_id, x0, x, pred, weight, bb_x0) from any source.

    ``in_runs``: within a partition the samples of an instance lie next to each other, in few runs.  Wide samples are then
    summed where they are; otherwise they are dealt first.
    """
    if d <= UNROLLED_GRAM:
        base, off = [f"b{f}" for f in range(d)], [f"d{f}" for f in range(d)]
        df = samples.selectExpr(
            "instance_id", *[f"x0[{f}] AS {b}" for f, b in enumerate(base)], "bb_x0",
            *[f"x[{f}] - x0[{f}] AS {o}" for f, o in enumerate(off)], "weight", "pred - bb_x0 AS y",
        )
        return _grouped(df, d, off, base)

    def sums_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, bb, w = numbers(batch["instance_id"]), numbers(batch["bb_x0"]), numbers(batch["weight"])
        x, x0, y = matrix(batch["x"]), matrix(batch["x0"]), numbers(batch["pred"]) - bb
        for r in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
            yield ids[r[0]], x0[r[0]], bb[r[0]], block_sums((x[r] - x0[r])[None], w[None, r], y[None, r])[0]

    dealt = samples.select("instance_id", "x0", "bb_x0", "x", "pred", "weight", salt_of(REPLAY_SALTS).alias("salt"))
    if not in_runs:
        # Samples are narrower than sums: they are dealt and ordered first, so a task writes one row per instance it holds.
        dealt = dealt.repartition("instance_id", "salt").sortWithinPartitions("instance_id")
    parts = dealt.drop("salt").mapInArrow(lambda batches: _runs(batches, sums_of, d), PARTIAL)
    return _added(parts, ["instance_id"])


PARTIAL = "instance_id BIGINT, x0 ARRAY<DOUBLE>, bb_x0 DOUBLE, s ARRAY<DOUBLE>"


def _runs(batches: Iterator[pa.RecordBatch], parts_of, d: int) -> Iterator[pa.RecordBatch]:
    """Adds up (id, x0, bb_x0, s) parts while the id stays the same; one sum is held at a time, however many parts it has."""
    done: list[tuple] = []
    held = None
    for batch in batches:
        if not len(batch):
            continue
        for key, x0, bb, s in parts_of(batch):
            if held is not None and held[0] == key:
                held = (key, held[1], held[2], held[3] + s)
                continue
            if held is not None:
                done.append(held)
                if len(done) >= rows_per_batch(d):
                    yield _batch(*map(np.array, zip(*done)))
                    done = []
            held = (key, x0, bb, s)
    if held is not None:
        yield _batch(*map(np.array, zip(*done, held)))


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        # numpy views of the vectors, one row at a time
        return zip(numbers(batch["instance_id"]), matrix(batch["x0"]), numbers(batch["bb_x0"]), matrix(batch["s"]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            if len(first):
                yield from _runs(chain([first], batches), rows_of, len(first["x0"][0]))

    ordered = parts.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.select("instance_id", "x0", "bb_x0", "s").mapInArrow(add, PARTIAL)


def merge_moments(parts: DataFrame) -> DataFrame:
    """Add up partial vectors in two steps, by range and then by instance, so no task has all parts of a hot instance."""
    some = _added(parts, ["instance_id", "salt"])
    return _added(some, ["instance_id"])


# --- Arrow blocks for wide instances ----------------------------------------------------------


def _batch(ids, x0, bb, s, **extra) -> pa.RecordBatch:
    columns = {"instance_id": pa.array(ids), "x0": vectors(x0), "bb_x0": pa.array(bb), "s": vectors(s)}
    columns.update({k: pa.array(v) for k, v in extra.items()})
    return pa.RecordBatch.from_pydict(columns)


def block_sums(off: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``s`` for offsets (m, b, D), weights (m, b), centred scores (m, b)."""
    m, b, d = off.shape
    if d <= draws.NARROW:
        return _narrow_sums(off, w, y)
    w_off = off * w[..., None]
    gram = np.matmul(w_off.transpose(0, 2, 1), off)
    rows, cols = np.triu_indices(d)
    wy = w * y
    head = np.stack([np.full(m, float(b)), w.sum(1), wy.sum(1), (wy * y).sum(1)], axis=1)
    return np.concatenate(
        [head, off.sum(1), (off * off).sum(1), w_off.sum(1), np.einsum("mbd,mb->md", w_off, y), gram[:, rows, cols]],
        axis=1,
    )


def _narrow_sums(off: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same feature by feature: no array of all products is made."""

    def total(*parts: np.ndarray) -> np.ndarray:
        return np.einsum(",".join(["mb"] * len(parts)) + "->m", *parts)

    m, b, d = off.shape
    x, wy = [off[..., f] for f in range(d)], w * y
    wx = [w * o for o in x]
    head = [np.full(m, float(b)), total(w), total(wy), total(wy, y)]
    by_feature = [*map(total, x), *(total(o, o) for o in x), *map(total, wx), *(total(o, y) for o in wx)]
    return np.stack(head + by_feature + [total(wx[i], x[j]) for i in range(d) for j in range(i, d)], axis=1)


def _blocked(df, model, background, n_samples, mask_prob, noise_std, kernel_width, seed, chunk, then: Then | None = None) -> DataFrame:
    means, width, d = np.array(background, dtype=float), float(kernel_width) ** 2, len(background)
    predict = predictor(model, df.sparkSession, background)
    seeds = [seed] if isinstance(seed, int) else list(seed)

    def block(ids, x0, bb, lo, hi, seed):
        keys = draws.sample_keys(seed, ids, np.arange(lo, hi + 1))
        off, masked = draws.draw_offsets(keys, x0, means, mask_prob, noise_std)
        y = predict(x0, off, masked) - bb[:, None]
        return block_sums(off, np.exp(-draws.squared(off) / width), y)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, rows_per_batch(d) // len(seeds))
            for at in range(0, len(batch), step):
                yield sums_of(batch.slice(at, step))

    def sums_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bb, x0 = numbers(batch["instance_id"]), numbers(batch["bb_x0"]), matrix(batch["x0"])
        first, last = numbers(batch["first_sample"]), numbers(batch["last_sample"])
        s = np.zeros((len(ids), len(seeds), size_of(d)))
        for r, lo, hi in blocks(first, last, d):
            for k, one in enumerate(seeds):
                s[r, k] += block(ids[r], x0[r], bb[r], lo, hi, one)
        s = s.reshape(len(ids), -1)
        return _batch(ids, x0, bb, s, salt=(first // chunk) % MERGE_SALTS)

    rows = df.select("instance_id", "x0", "bb_x0", "first_sample", "last_sample")
    if n_samples <= chunk and then is not None:
        return rows.mapInArrow(lambda batches: then[0](partial_sums(batches)), then[1])
    parts = rows.mapInArrow(partial_sums, PARTIAL + ", salt INT")
    sums = parts.drop("salt") if n_samples <= chunk else merge_moments(parts)
    return sums if then is None else sums.select("instance_id", "x0", "bb_x0", "s").mapInArrow(*then)


# --- the parts of ``s`` by name ---------------------------------------------------------------


def named(moments: DataFrame, d: int) -> DataFrame:
    """Moments as separate columns: n, sw, swy, swyy and the vectors sd, sdd, swd, swdy, g."""
    cuts = {k: f"slice(s, {HEAD + i * d + 1}, {d}) AS {k}" for i, k in enumerate(["sd", "sdd", "swd", "swdy"])}
    return moments.selectExpr(
        "instance_id", "x0", "bb_x0", "bigint(s[0]) AS n", "s[1] AS sw", "s[2] AS swy", "s[3] AS swyy",
        *cuts.values(), f"slice(s, {HEAD + 4 * d + 1}, {d * (d + 1) // 2}) AS g",
    )


def feature_stats(moments: DataFrame, d: int, eps: float = 1e-8) -> DataFrame:
    """One row per feature: unweighted sum, sum of squares, mean and population deviation + eps."""
    return (
        named(moments, d)
        .selectExpr("instance_id", "n", "posexplode(arrays_zip(x0, sd, sdd)) AS (feature_idx, c)")
        .selectExpr("instance_id", "feature_idx", "n", "c.x0 AS b", "c.sd AS sd", "c.sdd AS sdd")
        .selectExpr(
            "instance_id", "feature_idx", "n", "n * b + sd AS sum_x",
            "sdd + 2D * b * sd + n * b * b AS sum_xx", "b + sd / n AS mean",
            f"sqrt(greatest(sdd / n - (sd / n) * (sd / n), 0D)) + {double(eps)} AS std",
        )
    )


def zscore(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """Long cells (instance_id, sample_id, feature_idx, x) with ``x_norm``; stats are one row per cell column."""
    keys = ["instance_id", "feature_idx"]
    return salted_join(samples, stats.select(*keys, "mean", "std"), keys).withColumn(
        "x_norm", (F.col("x") - F.col("mean")) / F.col("std")
    )
