"""Perturbation: every instance row becomes B sample rows, in the executors, without a join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from localexplain.functions import arrow, draws
from localexplain.functions.draws import double
from localexplain.functions.sizes import SALT, SALT_RUN, SALTS
from localexplain.sources.models import BatchModel, Model, scores_of

SAMPLES_PER_TASK_ROW = 16384
INSTANCES_PER_TASK = 16  # so many fill the tasks evenly, whole
UNROLLED_VECTOR = 12


def checked_x0(d: int) -> str:
    """``x0``, or an error for a null, short, long or non-finite vector."""
    bad = (
        f"x0 IS NULL OR size(x0) <> {d} "
        "OR exists(x0, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity')) OR instance_id IS NULL"
    )
    message = f"concat('instance ', coalesce(string(instance_id), 'NULL'), ': x0 must hold {d} finite values')"
    return f"CASE WHEN {bad} THEN raise_error({message}) ELSE x0 END"


def _shuffle(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    if partitions == 0:
        return df
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unique_ids(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows; one that shares its keys with another is an error when it is read.

    Counted in a window on keys by which the rows are dealt already, while they are narrow.
    """
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat(F.lit("instance "), F.col("instance_id").cast("string"), F.lit(" occurs more than once"))
    checked = F.when(F.col("_same") > 1, F.raise_error(message).cast(df.schema["x0"].dataType)).otherwise(F.col("x0"))
    return df.withColumn("_same", same).withColumn("x0", checked).drop("_same")


def range_size(instances: DataFrame, n_samples: int, chunk: int, partitions: int | None = None) -> int:
    """Samples of one range: all of them where there are enough instances to keep every task busy.

    Ranges spread one instance over several tasks, and then their sums must be shuffled, which takes more room than
    the instances by far.  Only asked for B above ``chunk``; the count stops at as many instances as are needed.
    """
    if n_samples <= chunk:
        return chunk
    tasks = partitions or int(instances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = INSTANCES_PER_TASK * tasks
    return n_samples if instances.select("instance_id").limit(enough).count() == enough else chunk


def spread(
    instances: DataFrame, d: int, n_samples: int, partitions: int | None = None,
    chunk: int = SAMPLES_PER_TASK_ROW, keys: tuple[str, ...] = ("instance_id",), salted: bool = False,
) -> DataFrame:
    """Instances with (first_sample, last_sample), shuffled while they are still narrow.

    A row of D numbers is moved instead of its B samples or its O(D^2) sums; the sums are later
    grouped by ``instance_id`` on the same partitioning.  With B above ``chunk`` an instance becomes
    several sample ranges on several tasks, so one instance with a huge B is not one task.  The
    partition count is explicit because adaptive coalescing looks at bytes, and these few bytes
    stand for B times the work.  ``partitions=0`` keeps the input's own partitioning, for tables that
    arrive in enough even splits: wide instances then need no shuffle at all, narrow ones shuffle
    their sums. Repeated ``keys`` are an error on all paths but that one: there the caller vouches for them.
    ``salted`` deals ranges by instance and ``_salt``, as ``salted_join`` deals samples, whatever ``chunk`` is.
    """
    if n_samples < 1:
        raise ValueError("n_samples must be at least 1")
    # the id is made never null here and not later: a new column above the shuffle would not be known
    # to be partitioned, and the sums would be shuffled again
    df = instances.withColumns({"x0": F.expr(checked_x0(d)), "instance_id": F.expr("coalesce(instance_id, 0L)")})
    if salted:
        return _salted_ranges(df, d, n_samples, partitions, keys)
    if n_samples <= chunk:
        rows = df.selectExpr("*", "0 AS first_sample", f"{n_samples - 1} AS last_sample")
        rows = _shuffle(rows, partitions, "instance_id")
        return rows if partitions == 0 else unique_ids(rows, *keys)
    ranges = _ranges(df, n_samples, chunk)
    if partitions == 0:
        return ranges
    # few ranges hashed onto as many tasks would leave some idle, so the ranges of an instance go round
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = ranges.withColumn("_slot", F.expr(f"int(pmod(hash(instance_id) + bigint(first_sample / {chunk}), {n}))"))
    dealt = slots.repartitionById(n, F.col("_slot"))
    return unique_ids(dealt, "_slot", *keys, "first_sample").drop("_slot")


def _ranges(df: DataFrame, n_samples: int, size: int) -> DataFrame:
    last_range = math.ceil(n_samples / size) - 1
    return df.selectExpr("*", f"explode(sequence(0, {last_range})) AS range_id").selectExpr(
        "* EXCEPT (range_id)",
        f"int(range_id * {size}) AS first_sample",
        f"int(least((range_id + 1) * {size}, {n_samples}) - 1) AS last_sample",
    )


def _salted_ranges(df: DataFrame, d: int, n_samples: int, partitions: int | None, keys: tuple[str, ...]) -> DataFrame:
    """Ranges that have one salt and no more cells than a block; how many salts there are is told by the column."""
    if partitions == 0:
        raise ValueError("salted samples are dealt by their instances: partitions=0 keeps the input's own partitioning")
    size = SALT_RUN
    while size > 1 and size * d > arrow.CELLS_PER_BLOCK:
        size //= 2
    salts = min(SALTS, math.ceil(n_samples / SALT_RUN))
    ranges = _ranges(df, n_samples, size).selectExpr("*", f"int(pmod(first_sample DIV {SALT_RUN}, {salts})) AS {SALT}")
    dealt = _shuffle(ranges.withMetadata(SALT, {"salts": salts}), partitions, "instance_id", SALT)
    return unique_ids(dealt, SALT, *keys, "first_sample")


def perturb(
    instances: DataFrame,
    background,
    n_samples: int = 16384,
    mask_prob: float = 0.2,
    noise_std: float = 0.1,
    seed: int = 1234,
    layout: str = "array",
    partitions: int | None = None,
    chunk: int = SAMPLES_PER_TASK_ROW,
    keys: tuple[str, ...] = ("instance_id",),
    salted: bool = False,
) -> DataFrame:
    """B perturbed copies of every instance.

    A cell is masked (``z = 0``, value = background mean) with probability ``mask_prob``, else it is
    ``x0 + noise_std * N(0, 1)`` (``z = 1``); cells are independent.  ``layout="array"`` gives one
    row per sample with vectors ``x`` and ``z``; ``layout="long"`` one row per cell.  Other columns
    of ``instances`` are carried along.

    ``salted`` is for samples that will be joined with their instances (a replay): the same rows are made where that join
    needs them, and a column ``_salt`` says so.  With it they stay there, without it they are moved as any others.
    """
    if layout not in ("array", "long"):
        raise ValueError(f"samples are laid out as 'array' or 'long', not {layout!r}")
    d = len(background)
    ranges = spread(instances, d, n_samples, partitions, chunk, keys, salted)
    if layout == "array" and d > UNROLLED_VECTOR:
        if salted:
            return _placed_samples(ranges, background, mask_prob, noise_std, seed, keys)
        return wide_samples(ranges, background, mask_prob, noise_std, seed)
    df = ranges.selectExpr(
        "* EXCEPT (first_sample, last_sample)",
        "explode(sequence(first_sample, last_sample)) AS sample_id",
    )
    df = df.selectExpr("*", f"{draws.sample_key(seed)} AS sample_key")
    if layout == "long":
        return _cells_as_rows(df, background, mask_prob, noise_std)
    kept = [*instances.columns, *([SALT] if salted else []), "sample_id"]
    cells = [
        f"if({draws.mask_test('sample_key', draws.mask_word(f), mask_prob)}, "
        f"named_struct('x', {double(m)}, 'z', 0), "
        f"named_struct('x', x0[{f}] + {double(noise_std)} * {draws.normal(f)}, 'z', 1)) AS cell{f}"
        for f, m in enumerate(background)
    ]
    df = df.selectExpr("*", *draws.pair_columns(d)).selectExpr(*kept, *cells)
    names = [f"cell{f}" for f in range(d)]
    return df.selectExpr(
        *kept, f"array({', '.join(c + '.x' for c in names)}) AS x", f"array({', '.join(c + '.z' for c in names)}) AS z"
    )


def predictor(model: Model | BatchModel, spark, background=None):
    """A function (x0, offsets, masked) -> scores for blocks of samples, shapes (m, D), (m, b, D), (m, b, D) -> (m, b)."""
    if isinstance(model, Model):
        w, bias = np.array(model.w), float(model.bias)
        return lambda x0, off, masked: 1.0 / (1.0 + np.exp(-((x0 @ w + bias)[:, None] + draws.along(off, w))))
    shared, means = model.shipped(spark), np.array(background, dtype=float)
    # masked cells hold the background value itself, not x0 plus the rounded way to it
    return lambda x0, off, masked: scores_of(shared, np.where(masked, means, x0[:, None, :] + off))


def wide_samples(
    ranges: DataFrame, background, mask_prob: float, noise_std: float, seed: int, model=None,
    kernel_width: float = 1.0, keep_vectors: bool = True,
) -> DataFrame:
    """Samples of wide instances from Arrow blocks, with pred, dist and weight if a logistic model is given.

    Written out, so many columns would not fit generated code, and a higher-order function is
    interpreted per cell, more than ten times slower.  ``keep_vectors=False`` leaves x, z and x0 out,
    which are nearly all of the bytes.
    """
    d, means = len(background), np.array(background, dtype=float)
    carried = [
        f for f in ranges.schema.fields
        if f.name not in ("first_sample", "last_sample") and (keep_vectors or f.name != "x0")
    ]
    names = [f.name for f in carried]
    schema = T.StructType(list(carried)).add("sample_id", T.IntegerType())
    if keep_vectors:
        schema = schema.add("x", T.ArrayType(T.DoubleType())).add("z", T.ArrayType(T.IntegerType()))
    if model is not None:
        predict = predictor(model, ranges.sparkSession, background)
        for name in ("pred", "dist", "weight"):
            schema = schema.add(name, T.DoubleType())

    def block(batch: pa.RecordBatch, x0, ids, r, lo, hi) -> pa.RecordBatch:
        numbers = np.arange(lo, hi + 1, dtype=np.int32)
        off, masked = draws.draw_offsets(draws.sample_keys(seed, ids[r], numbers), x0[r], means, mask_prob, noise_std)
        taken = batch.select(names).take(pa.array(np.repeat(r, len(numbers))))
        columns = dict(zip(names, taken.columns)) | {"sample_id": pa.array(np.tile(numbers, len(r)))}
        if keep_vectors:
            x = np.where(masked, means, x0[r][:, None, :] + off)
            columns["x"] = arrow.vectors(x.reshape(-1, d))
            columns["z"] = arrow.vectors((~masked).astype(np.int32).reshape(-1, d))
        if model is not None:
            dist = (off * off).sum(2).ravel()
            columns["pred"] = pa.array(predict(x0[r], off, masked).ravel())
            columns["dist"] = pa.array(dist)
            columns["weight"] = pa.array(np.exp(-dist / kernel_width**2))
        return pa.RecordBatch.from_pydict(columns)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x0, ids = arrow.matrix(batch["x0"]), arrow.numbers(batch["instance_id"])
            spans = arrow.numbers(batch["first_sample"]), arrow.numbers(batch["last_sample"])
            for piece in arrow.blocks(*spans, d):
                yield block(batch, x0, ids, *piece)

    return ranges.mapInArrow(sample, schema)


def _placed_samples(
    ranges: DataFrame, background, mask_prob: float, noise_std: float, seed: int, keys: tuple[str, ...]
) -> DataFrame:
    """The rows of ``wide_samples``, drawn in a step behind which Spark still knows how the rows are dealt.

    Rows of ``mapInArrow`` are dealt in no known way, so the next join would move them all.  A window function keeps the
    partitioning: a range is a window of one row.  Its vectors are exploded as they are: a cut out of one long vector would
    copy that into every row wherever the plan above is not generated code.
    """
    d, means = len(background), np.array(background, dtype=float)

    @F.arrow_udf("array<array<double>>")
    def drawn(ids: pa.Array, x0: pa.Array, first: pa.Array, last: pa.Array) -> pa.Scalar:
        at, numbers = arrow.matrix(x0)[:1], np.arange(first[0].as_py(), last[0].as_py() + 1, dtype=np.int32)
        sample_keys = draws.sample_keys(seed, arrow.numbers(ids)[:1], numbers)
        off, masked = draws.draw_offsets(sample_keys, at, means, mask_prob, noise_std)
        x = arrow.vectors(np.where(masked, means, at[:, None, :] + off)[0])
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)[0]

    carried = [c for c in ranges.columns if c not in ("first_sample", "last_sample")]
    vectors = drawn("instance_id", "x0", "first_sample", "last_sample").over(Window.partitionBy(SALT, *keys, "first_sample"))
    rows = ranges.withColumn("_vectors", vectors).selectExpr("* EXCEPT (_vectors)", "posexplode(_vectors) AS (_at, x)")
    rows = rows.selectExpr(*carried, "first_sample + _at AS sample_id", "x")
    return rows.selectExpr("*", f"{draws.sample_key(seed)} AS sample_key").selectExpr(
        *carried, "sample_id", "x", f"transform(sequence(0, {d - 1}), f -> if({draws.cell_mask('f', mask_prob)}, 0, 1)) AS z"
    )


def _cells_as_rows(df: DataFrame, background, mask_prob: float, noise_std: float) -> DataFrame:
    means = "array(" + ", ".join(double(m) for m in background) + ")"
    return (
        df.selectExpr("*", "posexplode(x0) AS (feature_idx, value)")
        .selectExpr("*", f"{draws.cell_mask('feature_idx', mask_prob)} AS masked")
        .selectExpr(
            "* EXCEPT (sample_key, value, masked, x0)",
            f"if(masked, {means}[feature_idx], value + {double(noise_std)} * {draws.cell_normal('feature_idx')}) AS x",
            "if(masked, 0, 1) AS z",
        )
    )


def to_long(samples: DataFrame) -> DataFrame:
    """Array layout to one row per cell; ``z`` is NULL for replayed samples without a mask."""
    z = F.col("z") if "z" in samples.columns else F.lit(None).cast("array<int>")
    cells = F.posexplode(F.arrays_zip("x", F.coalesce(z, F.array().cast("array<int>")).alias("z")))
    keep = [c for c in samples.columns if c not in ("x", "z", "x0")]
    return samples.withColumn("z", z).select(*keep, cells.alias("feature_idx", "cell")).select(
        *keep, "feature_idx", F.col("cell.x").alias("x"), F.col("cell.z").alias("z")
    )


