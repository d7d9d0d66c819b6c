"""Black-box scores, distances and kernel weights: projections in the task that made the samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localexplain.functions import vectors
from localexplain.functions.arrow import matrix
from localexplain.functions.draws import double
from localexplain.sources.models import BatchModel, Model, scores_of


def logit(vec: str, model: Model) -> Column:
    """``bias + w.vec``; short vectors are written out so that they stay in generated code."""
    if model.d <= vectors.UNROLLED:
        terms = [f"{double(w)} * {vec}[{i}]" for i, w in enumerate(model.w)]
        return F.expr(" + ".join([double(model.bias), *terms]))
    return vectors.dot(F.col(vec), vectors.literal(model.w)) + F.lit(float(model.bias))


def logistic_link(logit_col: Column, bias: float = 0.0) -> Column:
    return vectors.sigmoid(logit_col + F.lit(float(bias)))


def batched_logit(vec: str, model: Model) -> Column:
    """The same logit as one matrix-vector product per Arrow batch."""
    w, bias = np.array(model.w), float(model.bias)

    @F.arrow_udf("double")
    def matvec(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(w))
        return pa.array(rows @ w + bias)

    return matvec(F.col(vec))


def batch_score(vec: str, model: BatchModel, spark) -> Column:
    """The scores of a black box that takes arrays, one call per Arrow batch."""
    shared = model.shipped(spark)

    @F.arrow_udf("double")
    def predict(x: pa.Array) -> pa.Array:
        return pa.array(scores_of(shared, matrix(x)) if len(x) else [], pa.float64())

    return predict(F.col(vec))


def score(
    samples: DataFrame, model: Model | BatchModel | Callable[[DataFrame], DataFrame], method: str = "custom"
) -> DataFrame:
    """Add ``pred``.  ``model`` is a logistic Model, a BatchModel or any function that adds the column itself."""
    if isinstance(model, BatchModel):
        return samples.withColumn("pred", batch_score("x", model, samples.sparkSession))
    if not isinstance(model, Model):
        scored = model(samples)
        if "pred" not in scored.columns:
            raise ValueError("the black box must add a column 'pred'")
        return scored
    if method == "custom":
        value = logit("x", model)
    elif method == "batched":
        value = batched_logit("x", model)
    else:
        raise ValueError(f"scoring is 'batched' or 'custom', not {method!r}")
    return samples.withColumn("pred", logistic_link(value))


def score_at_x0(instances: DataFrame, model: Model | BatchModel | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``bb_x0``, the black-box score of the instance itself."""
    if isinstance(model, Model):
        return instances.withColumn("bb_x0", logistic_link(logit("x0", model)))
    if isinstance(model, BatchModel):
        return instances.withColumn("bb_x0", batch_score("x0", model, instances.sparkSession))
    return score(instances.withColumn("x", F.col("x0")), model).drop("x").withColumnRenamed("pred", "bb_x0")


def sq_distance(a: Column, b: Column) -> Column:
    return vectors.squared_distance(a, b)


def check_width(kernel_width: float) -> None:
    if not kernel_width > 0:
        raise ValueError("kernel_width must be positive")


def kernel_weight(dist: Column, kernel_width: float = 1.0) -> Column:
    check_width(kernel_width)
    return F.exp(-dist / F.lit(float(kernel_width) ** 2))


def weigh(samples: DataFrame, kernel_width: float = 1.0, d: int | None = None) -> DataFrame:
    """Add ``dist`` (squared, unscaled) and ``weight``; needs ``x`` and ``x0``.

    With the vector length ``d`` known, short distances stay in generated code.
    """
    dist = sq_distance(F.col("x"), F.col("x0")) if d is None else vectors.squared_distance_of("x", "x0", d)
    with_dist = samples.withColumn("dist", dist)
    return with_dist.withColumn("weight", kernel_weight(F.col("dist"), kernel_width))


def run_means(scored: DataFrame) -> DataFrame:
    return scored.groupBy("instance_id").agg(
        F.avg("pred").alias("mean_pred"),
        F.avg("weight").alias("mean_weight"),
        F.count(F.lit(1)).alias("n_samples"),
    )
