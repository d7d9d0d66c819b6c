"""Stored samples, scores and fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localexplain import schemas
from localexplain.functions.names import feature_name
from localexplain.operators.perturb import perturb

SOLVER_NAMES = {0: "cholesky", 1: "gd"}


def write_samples(samples: DataFrame, path: str, model_id: str = "model") -> None:
    cols = [c for c in ("instance_id", "sample_id", "x", "z") if c in samples.columns]
    samples.select(F.lit(model_id).alias("model_id"), *cols).write.mode("overwrite").partitionBy(
        "model_id"
    ).parquet(path)


def generate_samples(
    instances: DataFrame, background, path: str, n_samples: int = 16384, mask_prob: float = 0.2,
    noise_std: float = 0.1, seed: int = 42, model_id: str = "model",
) -> None:
    """A stored sample set for replay."""
    write_samples(perturb(instances, background, n_samples, mask_prob, noise_std, seed), path, model_id)


def read_samples(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    """Samples for replay; ``z`` is NULL when none was stored."""
    df = spark.read.schema(schemas.SAMPLES + ", model_id STRING").parquet(path)
    return df if model_id is None else df.where(F.col("model_id") == model_id)


def write_scores(scored: DataFrame, path: str, model_id: str = "model") -> None:
    cols = ["instance_id", "sample_id", "pred", "dist", "weight"]
    scored.select(F.lit(model_id).alias("model_id"), *cols).write.mode("overwrite").partitionBy(
        "model_id"
    ).parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORES + ", model_id STRING").parquet(path)


def write_fits(fits: DataFrame, path: str) -> None:
    fits.write.mode("overwrite").parquet(path)


def normalize_fits(raw: DataFrame, instances: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Fit records with a numeric ``solver_id`` in the common layout.

    The solver gets its name, x0 comes from the instances, and ``feature_names`` is added.  A closed
    form has no loss curve, so ``loss`` is NULL.
    """
    known = F.create_map(*[F.lit(v) for item in SOLVER_NAMES.items() for v in item])
    out = raw.withColumn("solver", F.coalesce(F.try_element_at(known, F.col("solver_id")), F.lit("gd")))
    out = out.drop("solver_id", "x0").join(instances.select("instance_id", "x0"), "instance_id", "left")
    d = F.size("coeff")
    labelled = F.transform(F.sequence(F.lit(0), d - 1), lambda i: feature_name(i, names))
    return out.withColumn(
        "feature_names", labelled if names else F.lit(None).cast("array<string>")
    ).withColumn("loss", F.lit(None).cast("array<double>"))


OPTIONAL_FIT_FIELDS = {
    "r2": "double", "surr_x0": "double", "bb_x0": "double", "feature_names": "array<string>",
}


def load_fits(sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """Fits of several sources under one roof, tagged with ``source``; absent sources are left out
    and optional fields a source does not have are NULL."""
    out = None
    for name, df in sources.items():
        if df is None:
            continue
        part = df.withColumn("source", F.lit(name))
        for field, kind in OPTIONAL_FIT_FIELDS.items():
            if field not in part.columns:
                part = part.withColumn(field, F.lit(None).cast(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


def read_fits(spark: SparkSession, paths: Mapping[str, str | None]) -> DataFrame:
    return load_fits({n: spark.read.parquet(p) if p else None for n, p in paths.items()})


def write_attribution_csv(table: DataFrame, path: str) -> None:
    """The attribution table with its trailer rows; rows of an instance stay together and in order."""
    table.sortWithinPartitions("instance_id", "solver", "line").drop("line").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def bundle_outputs(samples: DataFrame, scored: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """x, pred and weight of every sample side by side, with ``z`` where there is one.

    ``sample_id`` is part of the join key, so a large instance spreads over all tasks.  Sort-merge joins: the three sides
    have a row per sample, but their sizes are estimated from the instances they were made of.
    """
    keys = ["instance_id", "sample_id"]
    out = samples.select(*keys, "x").join(scored.select(*keys, "pred", "weight").hint("merge"), keys)
    if masks is not None:
        return out.join(masks.select(*keys, "z").hint("merge"), keys, "left")
    return out.withColumn("z", F.lit(None).cast("array<int>"))
