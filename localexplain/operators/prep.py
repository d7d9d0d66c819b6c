"""Data preparation: exact stratified split, instance selection, black-box training, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.functions.draws import TWO_31, check_seed
from localexplain.operators.newton import train_logistic
from localexplain.operators.score import logit
from localexplain.sources.models import Model, by_feature

BUCKET_BITS = 16
MOST_CLASSES = 10000
WIDE = 32


def _order(key: str, seed: int) -> Column:
    return F.hash(F.lit(check_seed(seed)), F.col(key)).cast("bigint") + TWO_31


def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed random order (h, key) with 2^16 even buckets of it; ``key`` must be unique."""
    return df.withColumn("_h", _order(key, seed)).withColumn(
        "_bucket", F.shiftright("_h", 32 - BUCKET_BITS).cast("int")
    )


def split_points(
    df: DataFrame, label: str = "label", key: str = "row_id", test: float = 0.2, seed: int = 42
) -> DataFrame:
    """(label, quota, _cut_h, _cut_key): the last row of every class, in its random order, that is a test row.

    Found by radix: counts per (class, 2^16 buckets of the hash) say in which bucket the quota ends, and only the keys of
    that bucket, 1/65536 of a class, are put in order.  Rows themselves are never moved. Classes without a test row have
    nulls.
    """
    rows = _shuffled(df.select(F.col(label).alias("label"), F.col(key).alias("key")), "key", seed)
    by_class = Window.partitionBy("label")
    upto = by_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("after", F.sum("c").over(upto)).withColumn(
        "quota", F.round(F.sum("c").over(by_class) * F.lit(test)).cast("bigint")
    )
    # the quota ends in the one bucket where the count passes from below it to it or beyond
    ends = counts.where((F.col("after") >= F.col("quota")) & (F.col("after") - F.col("c") < F.col("quota")))
    ends = ends.select(
        F.col("label").alias("of"), F.col("_bucket").alias("at"), "quota", (F.col("quota") - F.col("after") + F.col("c")).alias("need")
    )
    found = rows.join(ends, F.col("label").eqNullSafe(F.col("of")) & (F.col("_bucket") == F.col("at")))
    rank = F.row_number().over(Window.partitionBy("of").orderBy("_h", "key"))
    last = found.withColumn("rank", rank).where(F.col("rank") == F.col("need"))
    return last.select("label", "quota", F.col("_h").alias("_cut_h"), F.col("key").alias("_cut_key"))


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "row_id", test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: exactly ``round(test * count)`` rows of every class are 'test'.

    The cut of each class is found first, by two narrow jobs over (label, key); then every row is compared with the cut of
    its class where it stands.  Up to MOST_CLASSES cuts come to the driver and travel with the plan; a label with more
    different values is joined by the planner's choice.  ``key`` must be unique.
    """
    cuts = split_points(df, label, key, test, seed).select(F.col("label").alias("_of"), "_cut_h", "_cut_key")
    few = cuts.limit(MOST_CLASSES + 1).collect()
    if len(few) <= MOST_CLASSES:
        cuts = F.broadcast(df.sparkSession.createDataFrame(few, cuts.schema))
    rows = df.withColumn("_h", _order(key, seed)).join(cuts, F.col(label).eqNullSafe(F.col("_of")), "left")
    before = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
    split = F.when(F.coalesce(before, F.lit(False)), "test").otherwise("train")
    return rows.withColumn("split", split).select(*df.columns, "split")


def select_instances(df: DataFrame, positions: Sequence[int], key: str = "row_id", seed: int = 42) -> DataFrame:
    """Rows at the given 0-based positions of the shuffled order, with ``position``.

    A position outside the table is an error.  Only the buckets that hold a position are ranked.
    """
    rows = _shuffled(df, key, seed)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("c"))
    total = df.count()
    bad = [p for p in positions if not 0 <= p < total]
    if bad:
        raise ValueError(f"no row stands at position {bad[0]}: the table ends at {total - 1}")
    # at most 2^BUCKET_BITS rows, whatever the table
    upto = Window.partitionBy(F.lit(1)).orderBy("_bucket")
    wanted = F.array(*[F.lit(int(p)).cast("bigint") for p in positions])
    offsets = counts.withColumn("_before", F.sum("c").over(upto) - F.col("c"))
    offsets = offsets.where(
        F.exists(wanted, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("c")))
    ).select("_bucket", "_before")
    in_bucket = Window.partitionBy("_bucket").orderBy("_h", key)
    return (
        rows.join(F.broadcast(offsets), "_bucket")  # at most one bucket per position
        .withColumn("position", F.col("_before") + F.row_number().over(in_bucket) - 1)
        .where(F.array_contains(wanted, F.col("position")))
        .select(*df.columns, "position")
    )


def train_black_box(
    train: DataFrame, c: float = 1.0, max_iter: int = 100, model_id: str = "logistic",
    dataset: str | None = None, d: int | None = None,
) -> Model:
    """L2 logistic regression on (x ARRAY<DOUBLE>, label) by Newton's method; ``d`` is read from a row if not given."""
    if d is None:
        first = train.select(F.size("x").alias("d")).first()
        if first is None:
            raise ValueError("no training rows")
        d = first.d
    beta, _ = train_logistic(train, d, c, max_iter)
    return Model(tuple(float(v) for v in beta[1:]), float(beta[0]), model_id, dataset)


def accuracy(test: DataFrame, model: Model) -> DataFrame:
    """Share of rows whose predicted class (logit > 0) is the label."""
    hit = (logit("x", model) > 0).cast("int") == F.col("label")
    return test.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def with_accuracy(test: DataFrame, model: Model) -> Model:
    """The model with its share of hits on ``test``, to be saved with it."""
    return replace(model, accuracy=accuracy(test, model).first().accuracy)


def background_means(train: DataFrame, d: int, vec: str = "x") -> DataFrame:
    """(feature_idx, mean) of the training vectors; null cells and cells that a short vector lacks are left out.

    Up to WIDE features one aggregate row of D averages; beyond, where that many columns no longer fit generated code,
    each task adds up its Arrow batches and sends D rows.
    """
    if d > WIDE:
        return _wide_means(train, d, vec)
    means = train.agg(*[F.avg(F.get(vec, F.lit(i))).alias(f"m{i}") for i in range(d)])
    return means.select(F.posexplode(F.array(*[f"m{i}" for i in range(d)])).alias("feature_idx", "mean"))


def _wide_means(train: DataFrame, d: int, vec: str) -> DataFrame:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(d), np.zeros(d, np.int64)
        for batch in batches:
            cells = batch.column(0).drop_null()
            flat, lengths = cells.flatten(), cells.value_lengths().to_numpy()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            usable = flat.is_valid().to_numpy(zero_copy_only=False) & (place < d)
            values = flat.to_numpy(zero_copy_only=False)
            total += np.bincount(place[usable], values[usable], d)
            seen += np.bincount(place[usable], minlength=d)
        yield pa.RecordBatch.from_pydict({"feature_idx": pa.array(np.arange(d, dtype=np.int32)), "total": total, "seen": seen})

    parts = train.select(F.col(vec).cast("array<double>")).mapInArrow(sums, "feature_idx INT, total DOUBLE, seen BIGINT")
    mean = F.try_divide(F.sum("total"), F.sum("seen")).alias("mean")
    none = train.sparkSession.range(d).selectExpr("int(id) AS feature_idx", "0D AS total", "0L AS seen")
    return parts.unionAll(none).groupBy("feature_idx").agg(mean)


def as_vector(means: DataFrame, d: int, digits: int | None = None) -> list[float]:
    """The d background means on the driver; ``digits`` makes them independent of summation order."""
    values = by_feature(means, "mean", d, "the table of background means")
    return values if digits is None else [round(v, digits) for v in values]


def vector_summary(df: DataFrame, columns: Sequence[str], mask: str | None = None) -> DataFrame:
    """min, max and mean of scalar or vector columns, one row each; zero / one counts of ``mask``.

    Vectors are reduced inside their row, nothing is exploded before the aggregation.
    """
    aggs, types = [], dict(df.dtypes)
    for c in columns:
        if types[c].startswith("array"):
            total = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
            low, high, size = F.array_min(c), F.array_max(c), F.size(c)
        else:
            total, low, high, size = F.col(c), F.col(c), F.col(c), F.when(F.col(c).isNotNull(), 1)
        aggs.append(
            F.struct(
                F.lit(c).alias("name"), F.min(low).cast("double").alias("min"), F.max(high).cast("double").alias("max"),
                F.try_divide(F.sum(total), F.sum(size)).alias("mean"), F.sum(size).cast("bigint").alias("n"),
                F.lit(None).cast("bigint").alias("zeros"), F.lit(None).cast("bigint").alias("ones"),
            ).alias(f"v_{c}")
        )
    if mask:
        ones = F.aggregate(mask, F.lit(0), lambda acc, v: acc + F.when(v == 1, 1).otherwise(0))
        zeros = F.aggregate(mask, F.lit(0), lambda acc, v: acc + F.when(v == 0, 1).otherwise(0))
        aggs.append(
            F.struct(
                F.lit(mask).alias("name"), F.min(F.array_min(mask)).cast("double").alias("min"),
                F.max(F.array_max(mask)).cast("double").alias("max"),
                F.try_divide(F.sum(ones).cast("double"), F.sum(F.size(mask))).alias("mean"),
                F.sum(F.size(mask)).cast("bigint").alias("n"),
                F.sum(zeros).cast("bigint").alias("zeros"), F.sum(ones).cast("bigint").alias("ones"),
            ).alias("v_mask")
        )
    one_row = df.agg(*aggs)
    return one_row.select(F.explode(F.array(*one_row.columns)).alias("v")).select("v.*")
