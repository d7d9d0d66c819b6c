"""Reports on fits.  A fit row holds its whole coefficient vector, so these need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.functions import vectors
from localexplain.functions.names import direction, display_name, feature_group, feature_name
from localexplain.operators.fit import local_delta
from localexplain.operators.second_pass import refit_curve
from localexplain.plans.explain import refit_samples
from localexplain.sources.models import BatchModel, Model


def top_k(fits: DataFrame, k: int = 15, names: Sequence[str] | None = None) -> DataFrame:
    """The k strongest features per fit by |coefficient|, ties by feature index; at most D rows."""
    ranked = F.posexplode(F.slice(vectors.by_strength(F.col("coeff")), 1, k))
    return (
        fits.select("instance_id", "solver", "coeff", ranked.alias("pos", "top"))
        .select(
            "instance_id",
            "solver",
            (F.col("pos") + 1).alias("rank"),
            F.col("top.idx").alias("feature_idx"),
            F.get("coeff", F.col("top.idx")).alias("coefficient"),
            F.size("coeff").alias("n_features"),
        )
        .withColumn("feature", feature_name(F.col("feature_idx"), names))
    )


def attribution_table(fits: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Every feature with group, |coefficient| and direction, then rows intercept and weighted_r2."""
    features = F.transform(
        F.col("coeff"),
        lambda c, i: F.struct(
            i.cast("int").alias("line"),
            feature_name(i, names).alias("feature"),
            feature_group(feature_name(i, names)).alias("group"),
            c.alias("coefficient"),
            F.abs(c).alias("abs_coefficient"),
            direction(c).alias("direction"),
        ),
    )

    def trailer(offset: int, label: str, value: str):
        return F.struct(
            (F.size("coeff") + offset).alias("line"),
            F.lit(label).alias("feature"),
            F.lit("").alias("group"),
            F.col(value).alias("coefficient"),
            F.lit(None).cast("double").alias("abs_coefficient"),
            F.lit("").alias("direction"),
        )

    trailers = F.array(trailer(0, "intercept", "intercept"), trailer(1, "weighted_r2", "r2"))
    return fits.select("instance_id", "solver", F.explode(F.concat(features, trailers)).alias("r")).select(
        "instance_id", "solver", "r.*"
    )


def consistency(fits: DataFrame, limit: float = 0.1) -> DataFrame:
    return fits.select(
        "instance_id", "solver", "surr_x0", "bb_x0", local_delta().alias("delta"),
        F.when(local_delta() < limit, "PASS").otherwise("WARN").alias("status"),
    )


def importance_data(fits: DataFrame, k: int = 15, names: Sequence[str] | None = None) -> DataFrame:
    """Bars of the importance chart: the top k from weakest (bar 0) to strongest; sign of zero is positive."""
    return top_k(fits, k, names).select(
        "instance_id", "solver", (F.least(F.lit(k), F.col("n_features")) - F.col("rank")).alias("bar"),
        display_name(F.col("feature")).alias("label"), "coefficient",
        F.when(F.col("coefficient") < 0, "negative").otherwise("positive").alias("sign"),
    )


def loss_curve_data(fits: DataFrame) -> DataFrame:
    """(epoch, loss) of the fits that have a loss curve."""
    return fits.select("instance_id", "solver", F.posexplode("loss").alias("epoch", "loss"))


def ablation_curve(
    fits: DataFrame, model, background, max_features: int = 20, include_intercept: bool = False, **sampling
) -> DataFrame:
    """Weighted MAE of the surrogate against the black box after the k strongest features are set to
    their sample mean, k = 0..min(max_features, D).

    The samples are made again from the fit rows; each adds its whole curve at once, so the only
    aggregation is one sum per k and fit.  Black boxes on arrays are drawn, scored and summed in one fused pass.
    """
    d = len(background)
    if isinstance(model, Model | BatchModel):
        return refit_curve(fits, model, background, max_features, include_intercept, **sampling)
    n = min(max_features, d)
    order = F.transform(F.slice(vectors.by_strength(F.col("coeff")), 1, n), lambda s: s["idx"])
    rows = fits.select("instance_id", "solver", "x0", "coeff", "intercept", "x_mean").withColumn("ord", order)
    rows = rows.withColumn("ord_coeff", F.transform("ord", lambda i: F.get("coeff", i))).withColumn(
        "ord_mean", F.transform("ord", lambda i: F.get("x_mean", i))
    )
    rows = refit_samples(rows, model, background, **sampling)
    start = vectors.dot_of("coeff", "x", d)
    if include_intercept:
        start = start + F.col("intercept")
    rows = rows.withColumn("p0", start).selectExpr(
        "instance_id", "solver", "weight", "pred", "p0",
        *[f"ord_coeff[{k}] * (ord_mean[{k}] - x[ord[{k}]]) AS step{k}" for k in range(n)],
    )
    curve = [" + ".join(["p0", *[f"step{j}" for j in range(k)]]) for k in range(n + 1)]
    sums = rows.groupBy("instance_id", "solver").agg(
        F.sum("weight").alias("sw"),
        *[F.expr(f"sum(weight * abs({c} - pred))").alias(f"e{k}") for k, c in enumerate(curve)],
    )
    points = F.posexplode(F.array(*[f"e{k}" for k in range(n + 1)])).alias("k", "error")
    return sums.select("instance_id", "solver", "sw", points).select(
        "instance_id", "solver", "k", F.try_divide("error", "sw").alias("wmae")
    )
