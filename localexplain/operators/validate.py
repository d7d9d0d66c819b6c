"""Checks of stored samples and scores against a recomputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from localexplain.functions import vectors
from localexplain.operators.score import score, weigh
from localexplain.plans.explain import with_instances
from localexplain.sources.models import Model


def replay_check(stored: DataFrame, instances: DataFrame, model, kernel_width: float = 1.0) -> DataFrame:
    """Stored (instance_id, sample_id, x, pred, weight) with recomputed values and |differences|.

    Every stored row is in the result: one whose instance is unknown has no recomputed values, and fails.
    """
    rows = with_instances(
        stored.withColumnsRenamed({"pred": "stored_pred", "weight": "stored_weight"}), instances
    )
    rows = weigh(score(rows, model), kernel_width, model.d if isinstance(model, Model) else None)
    return rows.withColumn("pred", F.when(F.col("x0").isNotNull(), F.col("pred"))).select(
        "instance_id", "sample_id", "stored_pred", "pred", "stored_weight", "weight",
        F.abs(F.col("stored_pred") - F.col("pred")).alias("pred_diff"),
        F.abs(F.col("stored_weight") - F.col("weight")).alias("weight_diff"),
    )


def _checked(replayed: DataFrame) -> DataFrame:
    """Two rows per sample: (name, stored, ref, diff)."""
    def part(name, column):
        return F.struct(
            F.lit(name).alias("name"), F.col(f"stored_{column}").alias("stored"), F.col(column).alias("ref"),
            F.col(f"{column}_diff").alias("diff"),
        )

    both = F.explode(F.array(part("preds", "pred"), part("weights", "weight")))
    return replayed.select(both.alias("c")).select("c.*")


def tolerance_report(
    replayed: DataFrame, tol_abs: float = 1e-4, tol_rel: float = 1e-3, tol: float | None = None
) -> DataFrame:
    """max / mean |diff|, max relative difference, both means and PASS per checked column; ``tol`` alone means no relative part.

    A row without a recomputed value counts as unmatched and does not pass.
    """
    if tol is not None:
        tol_abs, tol_rel = tol, 0.0
    passed = F.col("diff") <= F.lit(tol_abs) + F.lit(tol_rel) * F.abs("ref")
    return _checked(replayed).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("diff").alias("max_diff"),
        F.avg("diff").alias("mean_diff"),
        F.max(F.col("diff") / (F.abs("ref") + F.lit(1e-12))).alias("max_rel"),
        F.avg("stored").alias("mean_stored"),
        F.avg("ref").alias("mean_recomputed"),
        F.count_if(F.col("diff").isNull()).alias("unmatched"),
        F.bool_and(F.coalesce(passed, F.lit(False))).alias("passed"),
    )


def shape_check(samples: DataFrame, instances: DataFrame, n_samples: int) -> DataFrame:
    """Every instance, known or only stored, with its rows and distinct samples; 0 for one without samples.

    Passed is an instance that is known and has samples 0..n_samples-1, each once.
    """
    found = samples.groupBy("instance_id", "sample_id").agg(F.count(F.lit(1)).alias("rows"))
    found = found.groupBy("instance_id").agg(
        F.sum("rows").alias("n_rows"), F.count("sample_id").alias("n_found"),
        F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"),
    )
    known = instances.select("instance_id", F.lit(True).alias("known")).distinct()
    right = (F.col("n_rows") == n_samples) & (F.col("n_found") == n_samples) & (F.col("lo") == 0) & (F.col("hi") == n_samples - 1)
    return known.join(found, "instance_id", "full_outer").select(
        "instance_id",
        F.coalesce("known", F.lit(False)).alias("known"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("n_found", F.lit(0)).cast("bigint").alias("n_found"),
        F.coalesce(F.col("known") & right, F.lit(False)).alias("passed"),
    )


def mask_checks(samples: DataFrame, background) -> DataFrame:
    """Per instance: cells, masked cells, cells outside {0, 1} and masked cells off the background mean.

    Counted inside the row first, so a sample adds four numbers to the aggregation. A null cell of a mask is a bad one;
    a sample without a mask has no cells.
    """
    means = vectors.literal(background)
    off_mean = F.zip_with(
        F.arrays_zip("x", "z"), means,
        lambda c, m: F.coalesce((c["z"] == 0) & ~c["x"].eqNullSafe(m), F.lit(False)).cast("int"),
    )

    def count_if(cells):
        return F.aggregate(cells, F.lit(0), lambda acc, v: acc + v)

    counted = samples.select(
        "instance_id",
        F.size("z").alias("cells"),
        count_if(F.transform("z", lambda v: v.eqNullSafe(F.lit(0)).cast("int"))).alias("masked"),
        count_if(F.transform("z", lambda v: F.coalesce(~v.isin(0, 1), F.lit(True)).cast("int"))).alias("bad_mask"),
        count_if(off_mean).alias("bad_value"),
    )
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("cells", "masked", "bad_mask", "bad_value")]
    return (
        counted.groupBy("instance_id").agg(*sums)
        .withColumn("passed", (F.col("bad_mask") == 0) & (F.col("bad_value") == 0))
    )


def diff_histograms(values: DataFrame, columns: Sequence[str], bins: int = 8, width: int = 40) -> DataFrame:
    """(name, bin, lo, hi, n, bar): an equal-width histogram of each column on its [min, max], last bin closed, empty bins kept.

    A constant column is widened by 0.5 on both sides, a column without values has no rows.  All ranges come from one pass
    and all counts from another; a range is one row for each column, and counts are ``bins`` rows per column and task before
    they are shuffled.
    """
    ranges = values.agg(*[F.struct(F.lit(c).alias("name"), F.min(c).alias("low"), F.max(c).alias("high")).alias(f"_{i}") for i, c in enumerate(columns)])
    ranges = ranges.select(F.explode(F.array(*ranges.columns)).alias("r")).select("r.*").where("low IS NOT NULL")
    half = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    ranges = ranges.select("name", (F.col("low") - half).alias("low"), (F.col("high") + half).alias("high"))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int")
    counts = (
        values.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
        .join(F.broadcast(ranges), "name")
        .select("name", F.least(place, F.lit(bins - 1)).alias("bin"))
        .groupBy("name", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = ranges.select("name", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", "high")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    most = F.max("n").over(Window.partitionBy("name"))
    width_of = (F.col("high") - F.col("low")) / bins
    return (
        every.join(counts, ["name", "bin"], "left")
        .select(
            "name", "bin", (F.col("low") + F.col("bin") * width_of).alias("lo"),
            (F.col("low") + (F.col("bin") + 1) * width_of).alias("hi"), n.alias("n"),
        )
        .withColumn("bar", F.coalesce(F.floor(F.try_divide(F.lit(width) * F.col("n"), most)), F.lit(0)).cast("int"))
    )


def diff_histogram(values: DataFrame, column: str, bins: int = 8, width: int = 40) -> DataFrame:
    """``diff_histograms`` of one column, without its name."""
    return diff_histograms(values, [column], bins, width).drop("name")


def verdict(report: DataFrame, shapes: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """One row: do all checks pass?"""
    parts = [("tolerance", report), ("shape", shapes)] + ([("mask", masks)] if masks is not None else [])
    rows = None
    for name, part in parts:
        one = part.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")).select(
            F.lit(name).alias("check"), "passed"
        )
        rows = one if rows is None else rows.unionAll(one)
    return rows.agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("checks"))
