"""Black-box models, background means and instances: loading, saving, synthetic parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localexplain import schemas


@dataclass(frozen=True)
class Model:
    """Logistic black box ``1 / (1 + exp(-(bias + w.x)))``; D numbers, so it travels in the plan."""

    w: tuple[float, ...]
    bias: float
    model_id: str = "model"
    dataset: str | None = None
    accuracy: float | None = None

    @property
    def d(self) -> int:
        return len(self.w)


MOST_MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class BatchModel:
    """Any black box as a function from an array of rows (n, D) to n scores.

    It runs on Arrow blocks inside the tasks that draw the samples, so explanations keep their one-pass plan.  What the
    function carries (a network's weights, a forest) is broadcast once; it must stay below ``MOST_MODEL_BYTES``.
    """

    predict: Callable[[np.ndarray], np.ndarray]
    d: int
    model_id: str = "batch"

    def shipped(self, spark: SparkSession) -> Shipped:
        packed = CPickleSerializer().dumps(self.predict)
        if len(packed) > MOST_MODEL_BYTES:
            raise ValueError(f"{self.model_id} takes {len(packed)} bytes, more than the {MOST_MODEL_BYTES} that are broadcast")
        return Shipped(spark.sparkContext.broadcast(packed))


class Shipped:
    """A broadcast function, unpacked once in each task that calls it."""

    def __init__(self, packed: Broadcast):
        self.packed, self.function = packed, None

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if self.function is None:
            self.function = CPickleSerializer().loads(self.packed.value)
        return self.function(rows)

    def __getstate__(self) -> Broadcast:
        return self.packed

    def __setstate__(self, packed: Broadcast) -> None:
        self.packed, self.function = packed, None


def scores_of(predict: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """The scores of the last axis of x, one finite or non-finite number for each row; another shape is an error."""
    rows = x.reshape(-1, x.shape[-1])
    y = np.asarray(predict(rows), dtype=float)
    if y.shape != (len(rows),):
        raise ValueError(f"the black box gave an array of shape {y.shape} for {len(rows)} rows")
    return y.reshape(x.shape[:-1])


def synthetic_model(d: int) -> Model:
    # Fixed values of the synthetic parameters: W[i] = 0.02 (i + 1), bias = -1.
    return Model(tuple(0.02 * (i + 1) for i in range(d)), -1.0, "synthetic")


def synthetic_background(d: int) -> list[float]:
    return [0.5] * d


def synthetic_instances(spark: SparkSession, d: int, flat_x0: bool = False, n: int = 1) -> DataFrame:
    """``x0[i] = 1.0 if i % 5 == 0 else 0.5``; with ``flat_x0`` every value is 0.5."""
    value = "0.5D" if flat_x0 else "if(i % 5 = 0, 1D, 0.5D)"
    return spark.range(n).selectExpr(
        "id AS instance_id", f"transform(sequence(0, {d - 1}), i -> {value}) AS x0"
    )


def synthetic_params(spark: SparkSession, d: int, flat_x0: bool = False):
    return synthetic_model(d), synthetic_background(d), synthetic_instances(spark, d, flat_x0)


def model_frame(spark: SparkSession, model: Model) -> DataFrame:
    row = (model.model_id, list(model.w), float(model.bias), model.d, model.dataset, model.accuracy)
    return spark.createDataFrame([row], schemas.MODEL)


def write_model(model: Model, background, names, instances: DataFrame, path: str) -> None:
    """Four tables under ``path``: model, background, features, instances."""
    spark = instances.sparkSession
    if not len(background) == len(names) == model.d:
        raise ValueError("model, background and feature names differ in length")
    model_frame(spark, model).write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame(
        [(i, float(m)) for i, m in enumerate(background)], schemas.BACKGROUND
    ).write.mode("overwrite").parquet(f"{path}/background")
    spark.createDataFrame(list(enumerate(names)), schemas.FEATURES).write.mode("overwrite").parquet(
        f"{path}/features"
    )
    instances.select("instance_id", "x0").write.mode("overwrite").parquet(f"{path}/instances")


def read_model(spark: SparkSession, path: str):
    """(model, background, names, instances); a table with missing, repeated or extra rows is an error.

    The first three come to the driver, once their counts say that they hold the model's D rows; instances stay a table.
    """
    rows = spark.read.schema(schemas.MODEL).parquet(f"{path}/model").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}/model must hold exactly one model, found {len(rows)}")
    row = rows[0]
    if row.w is None or len(row.w) != row.d or row.d < 1:
        raise ValueError(f"{path}/model: {row.d} features announced, weights do not match")

    def vector(table, schema, column):
        return by_feature(spark.read.schema(schema).parquet(f"{path}/{table}"), column, row.d, f"{path}/{table}")

    model = Model(tuple(row.w), row.bias, row.model_id, row.dataset, row.accuracy)
    background = vector("background", schemas.BACKGROUND, "mean")
    names = vector("features", schemas.FEATURES, "name")
    instances = spark.read.schema(schemas.INSTANCES).parquet(f"{path}/instances")
    return model, background, names, instances


def by_feature(rows: DataFrame, column: str, d: int, what: str) -> list:
    """The values of features 0..d-1 on the driver; any other set of rows, or a null value, is an error.

    Read once: d + 1 rows at most come to the driver, one too many shows that there are too many.
    """
    found = sorted(rows.select("feature_idx", column).limit(d + 1).collect(), key=lambda r: (r[0] is not None, r[0]))
    if [r[0] for r in found] != list(range(d)) or any(r[1] is None for r in found):
        raise ValueError(f"{what} does not hold features 0..{d - 1}, each once with a value: {rows.count()} rows")
    return [r[1] for r in found]


def load_dataset(spark: SparkSession, name: str, specs: dict) -> DataFrame:
    """(row_id, x, label) of a named dataset.

    ``specs[name] = (path, id column, feature expressions, label expression)``, SQL text.
    """
    if name not in specs:
        raise ValueError(f"no dataset is called {name!r}; there are {', '.join(sorted(specs))}")
    path, key, features, label = specs[name]
    return spark.read.parquet(path).select(
        F.expr(key).cast("bigint").alias("row_id"),
        F.array(*[F.expr(f).cast("double") for f in features]).alias("x"),
        F.expr(label).cast("int").alias("label"),
    )
