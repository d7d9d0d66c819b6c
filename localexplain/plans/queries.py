"""The registered queries: every operator over whole tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame.  Numbers are rounded so that another engine's
summation order does not show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localexplain.functions import names as nm
from localexplain.functions import vectors
from localexplain.functions.vectors import tidy
from localexplain.operators import agree, fit, moments, perturb, prep, report, score, second_pass, timings, validate
from localexplain.plans import compare
from localexplain.plans import explain as ex
from localexplain.plans.sweep import sweep_fidelity
from localexplain.plans.workflow import evaluate, long_report
from localexplain.sources import logs, models, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

LINE_NAMES = ["mean quantity", "extendedprice error", "worst discount", "tax"]
PART_NAMES = ["size", "worst retailprice"]
B_VALUES = [32768, 65536, 131072]
MEAN_DIGITS = 9


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- instances --------------------------------------------------------------------------------


def read(spark, sf, table) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def line_instances(spark, sf) -> DataFrame:
    """One instance per (order, line number); the key repeats in the table, so the maximum decides."""
    features = ["l_quantity / 50", "l_extendedprice / 105000", "l_discount * 10", "l_tax * 12.5"]
    return (
        read(spark, sf, "lineitem")
        .groupBy(F.expr("l_orderkey * 10 + l_linenumber").alias("instance_id"))
        .agg(*[F.max(F.expr(e)).alias(f"f{i}") for i, e in enumerate(features)])
        .select("instance_id", F.array("f0", "f1", "f2", "f3").alias("x0"))
    )


def part_instances(spark, sf) -> DataFrame:
    return read(spark, sf, "part").selectExpr(
        "p_partkey AS instance_id", "array(p_size / 50D, (p_retailprice - 900) / 100) AS x0"
    )


def order_instances(spark, sf) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS instance_id", "array(o_totalprice / 500000, c_acctbal / 10000) AS x0"
    )


def vector_instances(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").selectExpr(
        "vec_id AS instance_id", "transform(embedding, v -> double(v)) AS x0"
    )


def document_instances(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").selectExpr("doc_id AS instance_id", "array(n_chars / 10000D) AS x0")


def background_of(instances: DataFrame, d: int) -> list[float]:
    return prep.as_vector(prep.background_means(instances, d, "x0"), d, MEAN_DIGITS)


def setup(instances: DataFrame, d: int):
    return instances, models.synthetic_model(d), background_of(instances, d)


def lines(spark, sf):
    return setup(line_instances(spark, sf), 4)


def parts(spark, sf):
    return setup(part_instances(spark, sf), 2)


def orders(spark, sf):
    return setup(order_instances(spark, sf), 2)


def embeddings(spark, sf):
    return setup(vector_instances(spark, sf), 64)


def documents(spark, sf):
    return setup(document_instances(spark, sf), 1)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


def settled(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """``rounded`` for means over a whole table of values with few decimals, whose last digit may be an exact tie.

    What the order of summation leaves (1e-14) goes first, then a tie goes to the even digit, whatever the tasks were.
    """
    return df.withColumns({c: F.bround(F.round(c, digits + 3), digits) + F.lit(0.0) for c in columns})


def long_coefficients(fits: DataFrame) -> DataFrame:
    return rounded(
        fits.select("instance_id", "solver", "intercept", F.posexplode("coeff").alias("feature_idx", "coefficient")),
        "coefficient", "intercept",
    )


# --- perturbation -----------------------------------------------------------------------------


@query
def perturb_cells(spark, sf):
    inst, _, bg = parts(spark, sf)
    return rounded(perturb.to_long(perturb.perturb(inst, bg, 32)), "x", digits=8)


@query
def perturb_long(spark, sf):
    inst, _, bg = orders(spark, sf)
    return rounded(perturb.perturb(inst, bg, 8, layout="long"), "x", digits=8)


@query
def perturb_mask_rate(spark, sf):
    inst, _, bg = orders(spark, sf)
    cells = perturb.perturb(inst, bg, 64).select(F.posexplode("z").alias("feature_idx", "z"))
    return cells.groupBy("feature_idx").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("z") == 0).alias("masked")
    )


@query
def synthetic_scores(spark, sf):
    """Synthetic parameters with 30 features, one instance per part; even keys use the flat x0."""
    model, bg, one = models.synthetic_params(spark, 30)
    _, _, flat = models.synthetic_params(spark, 30, flat_x0=True)
    kinds = one.select("x0", F.lit(1).alias("odd")).unionAll(flat.select("x0", F.lit(0).alias("odd")))
    keys = read(spark, sf, "part").selectExpr("p_partkey AS instance_id", "int(p_partkey % 2) AS odd")
    inst = keys.join(F.broadcast(kinds), "odd").select("instance_id", "x0")  # two rows of 30 numbers
    scored = ex.scored_samples(inst, model, bg, n_samples=16, keep_vectors=False)
    return rounded(score.run_means(scored), "mean_pred", "mean_weight")


# --- scoring and weighting --------------------------------------------------------------------


def _scores(df):
    return rounded(df.select("instance_id", "sample_id", "pred"), "pred", digits=8)


@query
def score_samples(spark, sf):
    inst, model, bg = lines(spark, sf)
    return _scores(score.score(perturb.perturb(inst, bg, 8), model))


@query
def score_batched(spark, sf):
    inst, model, bg = lines(spark, sf)
    return _scores(score.score(perturb.perturb(inst, bg, 8), model, method="batched"))


@query
def distance_weight(spark, sf):
    inst, _, bg = orders(spark, sf)
    weighed = score.weigh(perturb.perturb(inst, bg, 16), kernel_width=0.75)
    return rounded(weighed.select("instance_id", "sample_id", "dist", "weight"), "dist", "weight", digits=8)


@query
def run_means(spark, sf):
    inst, model, bg = orders(spark, sf)
    return rounded(score.run_means(ex.scored_samples(inst, model, bg, 64)), "mean_pred", "mean_weight")


@query
def score_at_x0(spark, sf):
    inst, model = line_instances(spark, sf), models.synthetic_model(4)
    return rounded(score.score_at_x0(inst, model).select("instance_id", "bb_x0"), "bb_x0", digits=8)


def two_unit_network(samples: DataFrame) -> DataFrame:
    """A shallow network as an example of a black box that is not the built-in one."""
    hidden = "tanh(2D * x[0] - x[1]) - 0.5D * tanh(x[0] + 3D * x[1])"
    return samples.withColumn("pred", F.expr(f"1D / (1D + exp(-({hidden})))"))


@query
def explain_network(spark, sf):
    inst, _, bg = orders(spark, sf)
    fits = ex.explain(inst, two_unit_network, bg, n_samples=32)
    rows = fits.select("instance_id", "solver", "intercept", "r2", F.posexplode("coeff").alias("feature_idx", "coefficient"))
    return rounded(rows, "coefficient", "intercept", "r2")


def three_units(x: np.ndarray) -> np.ndarray:
    """A shallow network on arrays: three tanh units with small whole weights, then a logistic one."""
    i = np.arange(x.shape[1])
    hidden = [np.tanh(x @ (((i * (j + 2)) % 7 - 3) / 20) + 0.1 * j) for j in range(3)]
    return 1 / (1 + np.exp(-(hidden[0] - 0.5 * hidden[1] + 0.25 * hidden[2])))


@query
def explain_batch_network(spark, sf):
    """A black box that takes arrays, on 64 features, in the one-pass plan."""
    inst, _, bg = embeddings(spark, sf)
    return long_coefficients(ex.explain(inst, models.BatchModel(three_units, 64, "network"), bg, n_samples=200))


@query
def replay_scores(spark, sf):
    inst, model, bg = parts(spark, sf)
    stored = perturb.perturb(inst, bg, 32, seed=42).select("instance_id", "sample_id", "x", "z")
    replayed = ex.scored_samples(inst, model, samples=stored)
    return rounded(
        replayed.select("instance_id", "sample_id", "pred", "dist", "weight"), "pred", "dist", "weight", digits=8
    )


@query
def bundle_outputs(spark, sf):
    inst, model, bg = parts(spark, sf)
    samples = perturb.perturb(inst, bg, 16)
    scored = score.weigh(score.score(samples, model))
    bundle = tables.bundle_outputs(samples, scored, samples)
    return rounded(
        bundle.select(
            "instance_id", "sample_id", F.expr("x[0]").alias("x_0"), F.expr("x[1]").alias("x_1"),
            F.expr("z[0]").alias("z_0"), F.expr("z[1]").alias("z_1"), "pred", "weight",
        ),
        "x_0", "x_1", "pred", "weight",
    )


# --- moments and fits -------------------------------------------------------------------------


def _moments(spark, sf, which, n):
    inst, model, bg = which(spark, sf)
    return moments.perturbed_moments(inst, model, bg, n, 0.2, 0.1, 1.0, 1234), model.d


@query
def feature_stats(spark, sf):
    sums, d = _moments(spark, sf, lines, 16)
    return rounded(moments.feature_stats(sums, d), "sum_x", "sum_xx", "mean", "std")


@query
def zscore_cells(spark, sf):
    inst, model, bg = parts(spark, sf)
    cells = perturb.perturb(inst, bg, 16, layout="long")
    sums, d = _moments(spark, sf, parts, 16)
    out = moments.zscore(cells, moments.feature_stats(sums, d))
    return rounded(out.select("instance_id", "sample_id", "feature_idx", "x_norm"), "x_norm")


@query
def gram_entries(spark, sf):
    sums, _ = _moments(spark, sf, orders, 32)
    system = fit.normal_equations(sums, ridge=1e-3).where("j >= 0")
    return rounded(system, "value")


@query
def rhs_entries(spark, sf):
    sums, _ = _moments(spark, sf, orders, 32)
    return rounded(fit.normal_equations(sums).where("j < 0").drop("j"), "value")


@query
def gram_wide(spark, sf):
    sums, _ = _moments(spark, sf, embeddings, 128)
    return rounded(fit.normal_equations(sums, ridge=1e-3), "value")


@query
def top_features(spark, sf):
    """Flagship: the three strongest features of every order line."""
    inst, model, bg = lines(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32)
    top = report.top_k(fits, 3, LINE_NAMES)
    return rounded(top.select("instance_id", "rank", "feature_idx", "feature", "coefficient"), "coefficient")


@query
def fit_cholesky(spark, sf):
    inst, model, bg = lines(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=32))


@query
def fit_single_feature(spark, sf):
    inst, model, bg = documents(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=32))


@query
def fit_gd(spark, sf):
    inst, model, bg = parts(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=32, solver="gd"))


@query
def fit_adam(spark, sf):
    inst, model, bg = parts(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=32, solver="adam"))


@query
def loss_curve(spark, sf):
    inst, model, bg = parts(spark, sf)
    curve = report.loss_curve_data(ex.explain(inst, model, bg, n_samples=32, solver="adam", epochs=100))
    return rounded(curve.select("instance_id", "epoch", "loss"), "loss")


@query
def fit_wide(spark, sf):
    inst, model, bg = embeddings(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=200))


@query
def fit_ranges(spark, sf):
    """More samples than one task row holds: the ranges of an instance are summed on several tasks, if instances are few."""
    inst, model, bg = lines(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=64, chunk=16))


@query
def fit_wide_ranges(spark, sf):
    inst, model, bg = embeddings(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, n_samples=200, chunk=64))


@query
def fit_replayed(spark, sf):
    """The fit of stored samples, scored again."""
    inst, model, bg = parts(spark, sf)
    stored = perturb.perturb(inst, bg, 32).select("instance_id", "sample_id", "x", "z")
    return long_coefficients(ex.explain(inst, model, bg, samples=stored))


@query
def fit_replayed_wide(spark, sf):
    """The same for wide instances, whose samples wait where the replay joins them."""
    inst, model, bg = embeddings(spark, sf)
    stored = perturb.perturb(inst, bg, 200, salted=True).select("instance_id", "sample_id", "x", "z", "_salt")
    return long_coefficients(ex.explain(inst, model, bg, samples=stored))


@query
def fit_stored(spark, sf):
    """The fit of stored samples with their stored scores and weights, here with four decimals; only x0 is scored."""
    stored, inst, model, bg = _stored(spark, sf)
    return long_coefficients(ex.explain(inst, model, bg, samples=stored, stored_scores=True))


@query
def fit_singular(spark, sf):
    """The same feature twice and no ridge: the second pivot is nothing but rounding, and the floor takes its place."""
    inst, model, bg = parts(spark, sf)
    samples = perturb.perturb(inst, bg, 32).selectExpr("instance_id", "sample_id", "array(x[0], x[0]) AS x")
    twice = inst.selectExpr("instance_id", "array(x0[0], x0[0]) AS x0")
    rows = ex.scored_samples(score.score_at_x0(twice, model), model, samples=samples)
    return long_coefficients(fit.fit(moments.sample_moments(rows, 2), ridge=0.0, pivot_floor=1e-2))


@query
def fit_fallback(spark, sf):
    """A black box without a value for some parts: their closed form is not finite, so GD reports."""
    inst, model, bg = parts(spark, sf)

    def partly_undefined(samples):
        undefined = F.expr("x0[0] > 0.5D")
        scored = score.score(samples, model)
        return scored.withColumn("pred", F.when(undefined, F.lit(float("nan"))).otherwise(F.col("pred")))

    fits = ex.explain(inst, partly_undefined, bg, n_samples=32)
    return fits.select("instance_id", "solver", "num_iters")


@query
def fit_quality(spark, sf):
    """R^2, prediction at x0 and the distance to the black box there, from the one-pass sums."""
    inst, model, bg = lines(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32).withColumn("delta", fit.local_delta())
    out = fits.select("instance_id", "r2", "surr_x0", "bb_x0", "delta", "sum_weights", "n_samples")
    return rounded(out, "r2", "surr_x0", "bb_x0", "delta", "sum_weights")


def _predicted(spark, sf, normalized):
    inst, model, bg = orders(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32)
    rows = fit.surrogate_predict(ex.refit_samples(fits, model, bg, n_samples=32))
    return rounded(fit.weighted_r2(rows, normalized=normalized), "r2", "sum_weights")


@query
def weighted_r2(spark, sf):
    return _predicted(spark, sf, False)


@query
def weighted_r2_norm(spark, sf):
    return _predicted(spark, sf, True)


@query
def weighted_r2_wide(spark, sf):
    """The same figure for 64 features, from samples that are never columns."""
    inst, model, bg = embeddings(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=200)
    out = second_pass.refit_r2(fits, model, bg, n_samples=200)
    return rounded(out.drop("solver"), "r2", "sum_weights")


@query
def surrogate_predictions(spark, sf):
    inst, model, bg = parts(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32)
    rows = fit.surrogate_predict(ex.refit_samples(fits, model, bg, n_samples=32))
    return rounded(rows.select("instance_id", "sample_id", "surr"), "surr")


# --- reports ----------------------------------------------------------------------------------


@query
def attribution_table(spark, sf):
    inst, model, bg = lines(spark, sf)
    out = report.attribution_table(ex.explain(inst, model, bg, n_samples=32), LINE_NAMES).drop("solver")
    return rounded(out, "coefficient", "abs_coefficient")


@query
def importance_data(spark, sf):
    inst, model, bg = lines(spark, sf)
    out = report.importance_data(ex.explain(inst, model, bg, n_samples=32), 15, LINE_NAMES)
    return rounded(out.drop("solver"), "coefficient")


@query
def consistency(spark, sf):
    inst, model, bg = lines(spark, sf)
    out = report.consistency(ex.explain(inst, model, bg, n_samples=32, mask_prob=0.5), limit=0.001)
    return rounded(out.drop("solver"), "surr_x0", "bb_x0", "delta")


@query
def ablation_curve(spark, sf):
    inst, model, bg = lines(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32)
    out = report.ablation_curve(fits, model, bg, n_samples=32)
    return rounded(out.drop("solver"), "wmae")


@query
def ablation_wide(spark, sf):
    inst, model, bg = embeddings(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=200)
    out = report.ablation_curve(fits, model, bg, 20, include_intercept=True, n_samples=200)
    return rounded(out.drop("solver"), "wmae")


# --- agreement --------------------------------------------------------------------------------


AGREEMENT = ["cosine", "spearman", "overlap", "max_abs_delta", "intercept_delta", "r2_delta", "x0_delta"]


@query
def compare_solvers(spark, sf):
    inst, model, bg = parts(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32, solver=("cholesky", "gd", "adam"))
    return rounded(
        agree.compare_pairs(fits.withColumn("source", F.col("solver")), fit.SOLVERS, k=1), *AGREEMENT
    )


@query
def compare_seeds(spark, sf):
    """Do two sample draws rank the features of an order line alike?"""
    inst, model, bg = lines(spark, sf)
    seeds = {f"seed {s}": s for s in (1234, 42)}
    return rounded(compare.compare_seeds(inst, model, bg, seeds, k=2, n_samples=32), *AGREEMENT)


@query
def compare_seeds_wide(spark, sf):
    """Three draws of 64 features."""
    inst, model, bg = embeddings(spark, sf)
    seeds = {f"seed {s}": s for s in (1234, 42, 7)}
    return rounded(compare.compare_seeds(inst, model, bg, seeds, n_samples=200), *AGREEMENT)


@query
def source_summary(spark, sf):
    inst, model, bg = parts(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32, solver=("cholesky", "gd", "adam"))
    out = agree.source_summary(fits.withColumn("source", F.col("solver")))
    return rounded(out, "intercept", "r2", "surr_x0", "bb_x0")


@query
def side_by_side(spark, sf):
    sums, _ = _moments(spark, sf, lines, 32)  # the ridge comes after the sums, both fits from one pass
    fits = fit.fit_sources(sums, {"closed": {}, "strong_ridge": {"ridge": 10.0}})
    out = agree.side_by_side(fits, ["closed", "strong_ridge", "absent"], LINE_NAMES, 2)
    return rounded(out, "closed", "strong_ridge", "absent")


@query
def normalize_fits(spark, sf):
    """Fit records with a numeric solver id and without x0, brought to the common layout."""
    inst, model, bg = parts(spark, sf)
    fits = ex.explain(inst, model, bg, n_samples=32, solver=("cholesky", "gd"))
    raw = fits.selectExpr(
        "instance_id", "if(solver = 'cholesky', 0, 1) AS solver_id", "ridge", "coeff", "intercept", "r2"
    )
    out = tables.normalize_fits(raw, inst, PART_NAMES).selectExpr(
        "instance_id", "solver", "ridge", "intercept", "r2", "x0[0] AS x0_0", "x0[1] AS x0_1",
        "array_join(feature_names, ',') AS feature_names", "loss IS NULL AS no_loss",
    )
    return rounded(out, "intercept", "r2", "x0_0", "x0_1")


# --- validation -------------------------------------------------------------------------------


def _stored(spark, sf):
    """Scores kept with four decimals, as a stand-in for values of another engine."""
    inst, model, bg = parts(spark, sf)
    scored = ex.scored_samples(inst, model, bg, n_samples=32).select(
        "instance_id", "sample_id", "x", "z", F.round("pred", 4).alias("pred"), F.round("weight", 4).alias("weight")
    )
    return scored, inst, model, bg


@query
def replay_check(spark, sf):
    stored, inst, model, _ = _stored(spark, sf)
    out = validate.replay_check(stored, inst, model)
    return rounded(out, "pred", "weight", "pred_diff", "weight_diff", digits=8)


@query
def tolerance_report(spark, sf):
    stored, inst, model, _ = _stored(spark, sf)
    out = validate.tolerance_report(validate.replay_check(stored, inst, model), 3e-5, 1e-4)
    return settled(rounded(out, "max_diff", "mean_diff", "max_rel", "mean_recomputed", digits=9), "mean_stored")


@query
def diff_histogram(spark, sf):
    stored, inst, model, _ = _stored(spark, sf)
    replayed = validate.replay_check(stored, inst, model)
    both = validate.diff_histograms(replayed, ["pred_diff", "weight_diff"])
    return rounded(both.withColumn("name", F.regexp_replace("name", "_diff$", "s")), "lo", "hi", digits=9)


@query
def shape_check(spark, sf):
    """Samples below a weight are gone; which orders still have all 16?"""
    inst, model, bg = orders(spark, sf)
    kept = ex.scored_samples(inst, model, bg, n_samples=16).where("weight > 0.9")
    return validate.shape_check(kept, inst, 16)


def _damaged(spark, sf):
    inst, _, bg = parts(spark, sf)
    samples = perturb.perturb(inst, bg, 32)
    hit = F.expr("x[0] > 0.95D")
    return samples.withColumn("z", F.when(hit, F.array(F.lit(2), F.lit(0))).otherwise(F.col("z"))), bg


@query
def mask_checks(spark, sf):
    samples, bg = _damaged(spark, sf)
    return validate.mask_checks(samples, bg)


def _broken(spark, sf):
    """Stored scores with planted damage: unknown instances, repeated and missing samples, null mask cells, wrong values."""
    stored, inst, model, bg = _stored(spark, sf)
    orphans = stored.where("instance_id % 50 = 7 AND sample_id < 8").selectExpr(
        "-instance_id AS instance_id", "sample_id", "x", "z", "0D AS pred", "0D AS weight"
    )
    # sample 7 of every eleventh part is stored under the number of sample 6
    repeated = F.when(F.expr("instance_id % 11 = 3 AND sample_id = 7"), 6).otherwise(F.col("sample_id")).cast("int")
    hole = F.when(F.expr("instance_id % 13 = 5 AND sample_id = 1"), F.array(F.lit(None).cast("int"), F.lit(7))).otherwise(F.col("z"))
    wrong = F.when(F.expr("instance_id % 17 = 2 AND sample_id = 3"), F.col("pred") + 0.5).otherwise(F.col("pred"))
    damaged = stored.withColumns({"sample_id": repeated, "z": hole, "pred": wrong})
    return damaged.unionByName(orphans), inst, model, bg


@query
def damage_tolerance(spark, sf):
    stored, inst, model, _ = _broken(spark, sf)
    out = validate.tolerance_report(validate.replay_check(stored, inst, model))
    return settled(rounded(out, "max_diff", "mean_diff", "max_rel", "mean_recomputed", digits=9), "mean_stored")


@query
def damage_shape(spark, sf):
    stored, inst, _, _ = _broken(spark, sf)
    return validate.shape_check(stored, inst, 32)


@query
def damage_masks(spark, sf):
    stored, _, _, bg = _broken(spark, sf)
    return validate.mask_checks(stored, bg)


@query
def damage_verdict(spark, sf):
    stored, inst, model, bg = _broken(spark, sf)
    report_ = validate.tolerance_report(validate.replay_check(stored, inst, model))
    return validate.verdict(report_, validate.shape_check(stored, inst, 32), validate.mask_checks(stored, bg))


@query
def verdict(spark, sf):
    stored, inst, model, bg = _stored(spark, sf)
    report_ = validate.tolerance_report(validate.replay_check(stored, inst, model))
    return validate.verdict(report_, validate.shape_check(stored, inst, 32), validate.mask_checks(stored, bg))


# --- data preparation -------------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    events = read(spark, sf, "events").selectExpr("event_id AS row_id", "event_type AS label")
    return prep.stratified_split(events)


@query
def binary_dataset(spark, sf):
    """Ten classes folded to two, first class against the rest."""
    specs = {
        "embeddings_binary": (
            f"{sf}/embeddings.parquet", "vec_id", [f"embedding[{i}]" for i in range(64)], "int(label <> 0)"
        )
    }
    out = models.load_dataset(spark, "embeddings_binary", specs)
    cells = out.select("row_id", "label", F.posexplode("x").alias("feature_idx", "x"))
    return rounded(cells, "x")


@query
def background_means(spark, sf):
    split = prep.stratified_split(
        read(spark, sf, "embeddings").selectExpr("vec_id AS row_id", "embedding AS x", "label")
    )
    train = split.where("split = 'train'").withColumn("x", F.expr("transform(x, v -> double(v))"))
    return rounded(prep.background_means(train, 64), "mean")


@query
def select_instances(spark, sf):
    split = prep.stratified_split(
        read(spark, sf, "orders").selectExpr("o_orderkey AS row_id", "o_totalprice", "o_orderstatus AS label")
    )
    test = split.where("split = 'test'").drop("split")
    return prep.select_instances(test, [0, 30, 77])


@query
def vector_summary(spark, sf):
    inst, model, bg = lines(spark, sf)
    scored = ex.scored_samples(inst, model, bg, n_samples=8)
    out = prep.vector_summary(scored, ["x0", "x", "pred", "weight"], mask="z")
    return rounded(out, "min", "max", "mean")


def _divided(spark, sf, vector="transform(embedding, v -> double(v))"):
    """Training and test rows (row_id, x, label): the first class against the rest."""
    rows = read(spark, sf, "embeddings").selectExpr("vec_id AS row_id", f"{vector} AS x", "int(label = 0) AS label")
    split = prep.stratified_split(rows)
    return split.where("split = 'train'"), split.where("split = 'test'")


def _trained(spark, sf):
    train, test = _divided(spark, sf)
    return prep.train_black_box(train.select("x", "label")), train, test


FEW = "transform(slice(embedding, 1, 4), v -> double(v))"


@query
def trained_weights(spark, sf):
    """Intercept (feature -1) and weights of the black box on four features, at a weak and a strong penalty."""
    train, _ = _divided(spark, sf, FEW)
    parts = []
    for c in (1.0, 0.01):
        model = prep.train_black_box(train, c)
        cells = spark.range(1).select(F.posexplode(vectors.literal([model.bias, *model.w])).alias("i", "weight"))
        parts.append(cells.select(F.lit(c).alias("c"), (F.col("i") - 1).alias("feature_idx"), "weight"))
    return rounded(parts[0].unionAll(parts[1]), "weight")


@query
def evaluate_trained(spark, sf):
    """The whole workflow on a trained model: three solvers from one set of sums, pairs, consistency, ablation."""
    train, test = _divided(spark, sf, FEW)
    return rounded(long_report(evaluate(train, test, k=2, limit=0.001, n_samples=64)), "value")


@query
def black_box_accuracy(spark, sf):
    model, _, test = _trained(spark, sf)
    return prep.accuracy(test, model)


@query
def explain_trained(spark, sf):
    """Train on 80 %, then explain every held-out vector with the trained model."""
    model, train, test = _trained(spark, sf)
    bg = prep.as_vector(prep.background_means(train, model.d), model.d, MEAN_DIGITS)
    inst = test.selectExpr("row_id AS instance_id", "x AS x0")
    fits = ex.explain(inst, model, bg, n_samples=200)
    return rounded(report.top_k(fits, 10).drop("solver", "n_features"), "coefficient")


# --- benchmark logs ---------------------------------------------------------------------------


def log_lines(spark, sf) -> DataFrame:
    """A log per event type: every event is a tag, a bare, a complete, a CPU, a detail or another line."""
    d = "element_at(array(128, 256, 512), int(user_id % 3) + 1)"
    b = f"element_at(array({', '.join(map(str, B_VALUES))}), int((user_id DIV 3) % 3) + 1)"
    tag = f"concat('D=', {d}, ' B=', {b})"
    times = (
        "concat('Timing (ms): gen ', v1, '  infer ', v2, '  weights ', v4, '  total ', v8)"
    )
    line = (
        "CASE int(event_id % 7) "
        f"WHEN 0 THEN concat({tag}, ' run=', string(event_id % 6 + 1), ' ', {times}) "
        f"WHEN 1 THEN {tag} "
        f"WHEN 2 THEN {times} "
        f"WHEN 3 THEN concat({tag}, ' ', {times}) "
        f"WHEN 4 THEN concat({tag}, ' CPU ', {times}) "
        f"WHEN 5 THEN concat('  CPU ', {times}, ' ') "
        "ELSE concat('Timing detail (ms): gen_init ', v1, '  perturb ', v1) END"
    )
    # three decimals, written as text from whole thousandths so that both engines write the same
    thousandths = "cast(round(value) AS BIGINT) * 1000 + event_id % 1000"
    written = "concat(string({n} DIV 1000), '.', lpad(string({n} % 1000), 3, '0'))"
    events = read(spark, sf, "events").withColumn("n", F.expr(thousandths))
    events = events.withColumns({f"v{k}": F.expr(written.format(n=f"(n * {k})")) for k in (1, 2, 4, 8)})
    return logs.number_lines(
        events.select(
            F.concat(F.col("event_type"), F.lit(".log")).alias("file"),
            F.col("event_id").alias("line_no"),
            F.expr(line).alias("value"),
        )
    )


@query
def timing_tagged(spark, sf):
    both = [
        timings.parse_tagged(log_lines(spark, sf), k).withColumn("kind", F.lit(k)) for k in ("gpu", "cpu")
    ]
    return both[0].unionAll(both[1]).drop("chunk")


@query
def timing_carry(spark, sf):
    return timings.parse_bare(log_lines(spark, sf), "gpu").drop("chunk")


def _device(spark, sf, kind):
    return timings.mean_by_key(timings.parse_log(log_lines(spark, sf), kind), drop=1)


@query
def timing_drop_first(spark, sf):
    return timings.drop_first(timings.parse_log(log_lines(spark, sf), "gpu"), 2).drop("chunk")


@query
def timing_means(spark, sf):
    return rounded(_device(spark, sf, "cpu"), *timings.STAGES)


@query
def timing_means_two(spark, sf):
    """Without the first two runs of every key."""
    return rounded(timings.mean_by_key(timings.parse_log(log_lines(spark, sf), "gpu"), drop=2), *timings.STAGES)


@query
def timing_combined(spark, sf):
    return timings.parse_combined(log_lines(spark, sf))


def _merged(spark, sf):
    """Devices from the combined log; the GPU side lacks the smallest D, the CPU side the largest B."""
    both = timings.parse_combined(log_lines(spark, sf))
    return timings.merge_devices(
        both.where("kind = 'gpu' AND D > 128"), both.where(f"kind = 'cpu' AND B < {B_VALUES[-1]}")
    )


@query
def timing_merge(spark, sf):
    return _merged(spark, sf)


def _both(spark, sf):
    both = timings.parse_combined(log_lines(spark, sf))
    return timings.merge_devices(both.where("kind = 'gpu'"), both.where("kind = 'cpu'"))


@query
def speedup_matrix(spark, sf):
    out = timings.speedup_matrix(_both(spark, sf), B_VALUES)
    return rounded(out, *[f"b_{b}" for b in B_VALUES])


@query
def stage_breakdown(spark, sf):
    return rounded(timings.stage_breakdown(_both(spark, sf)), "value", "bottom")


@query
def timing_grid(spark, sf):
    """The different D and B of a merged table, in order."""
    values = timings.grid_values(_merged(spark, sf))
    return values.select(F.array_join("d_values", ",").alias("d_values"), F.array_join("b_values", ",").alias("b_values"))


@query
def total_series(spark, sf):
    return timings.total_series(_both(spark, sf))


@query
def sweep_grid(spark, sf):
    """Mean surrogate quality over a D x B x run grid; a run is a seed."""
    inst, model, bg = lines(spark, sf)
    return rounded(sweep_fidelity(inst, model, bg, [2, 4], [16, 32], 2), "mean_r2", "mean_delta")


@query
def display_names(spark, sf):
    """Report names of made feature names, one per part."""
    prefix = "element_at(array('mean ', 'worst ', '', 'mean '), int(p_partkey % 4) + 1)"
    suffix = "element_at(array('', ' error', ''), int(p_partkey % 3) + 1)"
    rows = read(spark, sf, "part").selectExpr("p_partkey", f"concat({prefix}, p_name, {suffix}) AS feature")
    return rows.select(
        "p_partkey", "feature",
        nm.feature_group(F.col("feature")).alias("group"), nm.display_name(F.col("feature")).alias("label"),
    )
