import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.operators import fit as fits_mod
from localexplain.operators import moments, score
from localexplain.operators.perturb import perturb
from localexplain.plans.explain import explain, refit_samples, scored_samples
from localexplain.sources.models import Model, synthetic_instances, synthetic_model


def setup(spark, d, n=4):
    inst = synthetic_instances(spark, d, n=n).withColumn(
        "x0", F.expr("transform(x0, (v, i) -> v + 0.03 * i + 0.1 * instance_id)")
    )
    return inst, synthetic_model(d), [0.5 + 0.01 * i for i in range(d)]


def by_key(df, solver=None):
    rows = [r for r in df.collect() if solver in (None, r.solver)]
    return {r.instance_id: r for r in rows}


def arrays(inst, model, bg, b, **kw):
    x = brute.stack(perturb(inst, bg, b, **kw), "x")
    x0 = brute.stack(inst.selectExpr("*", "0 AS sample_id"), "x0")[:, 0]
    return x, x0


@pytest.mark.parametrize("d", [1, 2, 5, 8, 9, 20])
def test_all_solvers_match_the_samples(spark, d):
    inst, model, bg = setup(spark, d)
    x, x0 = arrays(inst, model, bg, 60)
    got = explain(inst, model, bg, n_samples=60, solver=("cholesky", "gd", "adam"), epochs=120, gd_iters=150)
    for i in range(len(x)):
        y, w = brute.scores(x[i], model.w, model.bias), brute.weights(x[i], x0[i])
        *ad, loss = brute.adam(x[i], y, w, 120)
        expected = {
            "cholesky": brute.closed_form(x[i], y, w), "gd": brute.descent(x[i], y, w, iters=150), "adam": tuple(ad)
        }
        for solver, (coeff, intercept) in expected.items():
            row = by_key(got, solver)[i]
            assert np.allclose(row.coeff, coeff, atol=1e-8) and abs(row.intercept - intercept) < 1e-8
            assert np.isclose(row.r2, brute.r2(x[i], y, w, coeff, intercept, solver == "adam"), rtol=1e-7, atol=1e-7)
            assert abs(row.surr_x0 - (intercept + coeff @ x0[i])) < 1e-8
            assert abs(row.bb_x0 - brute.scores(x0[i], model.w, model.bias)) < 1e-12
            assert row.n_samples == 60 and np.allclose(row.x_mean, x[i].mean(0))
        assert np.allclose(by_key(got, "adam")[i].loss, loss, atol=1e-9)
        assert by_key(got, "cholesky")[i].loss is None


@pytest.mark.parametrize("d", [3, 11])
def test_ranges_replay_and_custom_black_box_agree(spark, d):
    inst, model, bg = setup(spark, d)
    base = by_key(explain(inst, model, bg, n_samples=50))
    stored = perturb(inst, bg, 50).select("instance_id", "sample_id", "x", "z")
    others = [
        explain(inst, model, bg, n_samples=50, chunk=8, partitions=5),
        explain(inst, model, samples=stored),
        explain(inst, lambda df: score.score(df, model, "batched"), bg, n_samples=50),
    ]
    for other in others:
        for i, row in by_key(other).items():
            assert np.allclose(row.coeff, base[i].coeff, atol=1e-9) and abs(row.r2 - base[i].r2) < 1e-8


def test_one_hot_instance_among_many(spark):
    """One instance owns most stored samples; salting and partial sums keep its result whole."""
    inst, model, bg = setup(spark, 3, n=5)
    few = perturb(inst, bg, 20).where("instance_id <> 2")
    many = perturb(inst.where("instance_id = 2"), bg, 5000, chunk=500)
    got = by_key(explain(inst, model, samples=few.unionByName(many)))
    alone = by_key(explain(inst.where("instance_id = 2"), model, bg, n_samples=5000))
    assert got[2].n_samples == 5000 and got[0].n_samples == 20
    assert np.allclose(got[2].coeff, alone[2].coeff, atol=1e-9)


def test_normal_equations(spark):
    inst, model, bg = setup(spark, 3, n=2)
    x, x0 = arrays(inst, model, bg, 40)
    sums = moments.perturbed_moments(inst, model, bg, 40, 0.2, 0.1, 1.0, 1234)
    rows = fits_mod.normal_equations(sums, ridge=0.5).toPandas()
    for i in range(2):
        y, w = brute.scores(x[i], model.w, model.bias), brute.weights(x[i], x0[i])
        *_, a, b = brute.normal_system(x[i], y, w)
        a = a + 0.5 * np.eye(4)
        part = rows[rows.instance_id == i]
        for r in part.itertuples():
            expected = b[r.i] if r.j < 0 else a[r.i, r.j]
            assert abs(r.value - expected) < 1e-9
        assert np.linalg.eigvalsh(a).min() > 0
        beta = np.linalg.solve(a, b)
        assert np.abs(a @ beta - b).max() < 1e-10


def test_weighted_r2_from_samples_equals_one_pass(spark):
    inst, model, bg = setup(spark, 4)
    fits = explain(inst, model, bg, n_samples=30)
    rows = fits_mod.surrogate_predict(refit_samples(fits, model, bg, n_samples=30))
    for normalized in (False, True):
        second = by_key(fits_mod.weighted_r2(rows, normalized=normalized).withColumn("solver", F.lit("x")))
        for i, row in by_key(fits).items():
            assert abs(row.r2 - second[i].r2) < 1e-8


def test_constant_feature(spark):
    """No noise and x0 equal to the mean: the feature never moves and gets no attribution."""
    inst, model, _ = setup(spark, 3, n=1)
    x0 = inst.first().x0
    bg = [x0[0] + 0.2, x0[1], x0[2] - 0.3]
    for solver in ("cholesky", "gd", "adam"):
        row = explain(inst, model, bg, n_samples=64, noise_std=0.0, solver=solver).first()
        assert row.coeff[1] == 0.0 and row.coeff[0] != 0.0 and np.isfinite(row.coeff).all()


def test_everything_masked_to_a_far_mean(spark):
    inst, model, bg = setup(spark, 2, n=1)
    row = explain(inst, model, [0.1, 0.9], n_samples=10, mask_prob=1.0).first()
    assert list(row.coeff) == [0.0, 0.0] and row.r2 == 0.0 and np.isfinite(row.intercept)


@pytest.mark.parametrize("d", [2, 10])
def test_no_weight_left(spark, d):
    inst, model, bg = setup(spark, d, n=1)
    for solver in ("cholesky", "gd", "adam"):
        row = explain(inst, model, bg, n_samples=16, kernel_width=1e-6, mask_prob=0.0, solver=solver).first()
        assert row.sum_weights == 0.0 and row.r2 == 0.0 and np.allclose(row.coeff, 0.0)


def test_single_sample_and_identical_instances(spark):
    inst, model, bg = setup(spark, 2, n=1)
    row = explain(inst, model, bg, n_samples=1).first()
    assert list(row.coeff) == [0.0, 0.0] and row.n_samples == 1
    twins = inst.selectExpr("explode(array(10L, 11L)) AS instance_id", "x0")
    rows = by_key(explain(twins, model, bg, n_samples=50))
    assert len(rows) == 2 and not np.array_equal(rows[10].coeff, rows[11].coeff)


def test_no_instances(spark):
    inst, model, bg = setup(spark, 2)
    none = inst.where("false")
    assert explain(none, model, bg, n_samples=5).count() == 0
    assert perturb(none, bg, 5).count() == 0


def test_non_finite_closed_form_falls_back(spark):
    inst, model, bg = setup(spark, 2, n=3)

    def broken(df):
        good = score.score(df, model)
        return good.withColumn("pred", F.when(F.col("instance_id") == 1, F.lit(float("inf"))).otherwise(F.col("pred")))

    rows = by_key(explain(inst, broken, bg, n_samples=10))
    assert (rows[1].solver, rows[1].num_iters) == ("gd", 500)
    assert (rows[0].solver, rows[0].num_iters) == ("cholesky", 0) and np.isfinite(rows[0].coeff).all()


def test_pivot_floor(spark):
    """A singular system without ridge still gives finite numbers."""
    inst, model, bg = setup(spark, 3, n=1)
    row = explain(inst, model, bg, n_samples=2, ridge=0.0).first()
    assert row.solver in ("cholesky", "gd")


def test_unknown_names_raise(spark):
    inst, model, bg = setup(spark, 2)
    with pytest.raises(ValueError, match="no solver"):
        explain(inst, model, bg, solver="newton")
    with pytest.raises(ValueError, match="scoring is"):
        score.score(perturb(inst, bg, 2), model, method="magic")
    with pytest.raises(ValueError, match="pred"):
        score.score(perturb(inst, bg, 2), lambda df: df)
    with pytest.raises(ValueError, match="positive"):
        score.weigh(perturb(inst, bg, 2), 0.0)


@pytest.mark.parametrize("d", [3, 40])
def test_scores_and_weights(spark, d):
    inst, model, bg = setup(spark, d, n=2)
    x, x0 = arrays(inst, model, bg, 15)
    a = scored_samples(inst, model, bg, n_samples=15, kernel_width=0.7).orderBy("instance_id", "sample_id").toPandas()
    b = scored_samples(inst, model, bg, n_samples=15, kernel_width=0.7, method="batched").orderBy("instance_id", "sample_id").toPandas()
    assert np.allclose(a.pred, brute.scores(x, model.w, model.bias).ravel(), atol=1e-12)
    assert np.allclose(a.pred, b.pred, atol=1e-9)
    assert np.allclose(a.weight, brute.weights(x, x0[:, None], 0.7).ravel(), atol=1e-12)
    assert np.allclose(a.dist, ((x - x0[:, None]) ** 2).sum(-1).ravel(), atol=1e-12)
    means = score.run_means(scored_samples(inst, model, bg, n_samples=15)).orderBy("instance_id").toPandas()
    assert np.allclose(means.mean_pred, brute.scores(x, model.w, model.bias).mean(1))


def test_feature_stats_and_zscores(spark):
    inst, model, bg = setup(spark, 3, n=3)
    x, _ = arrays(inst, model, bg, 25)
    sums = moments.perturbed_moments(inst, model, bg, 25, 0.2, 0.1, 1.0, 1234)
    stats = moments.feature_stats(sums, 3)
    pdf = stats.orderBy("instance_id", "feature_idx").toPandas()
    assert np.allclose(pdf["sum_x"], x.sum(1).ravel()) and np.allclose(pdf["sum_xx"], (x * x).sum(1).ravel())
    assert np.allclose(pdf["std"], x.std(1).ravel() + 1e-8) and np.allclose(pdf["mean"], x.mean(1).ravel())
    cells = moments.zscore(perturb(inst, bg, 25, layout="long"), stats)
    z = cells.orderBy("instance_id", "sample_id", "feature_idx").toPandas()["x_norm"].to_numpy().reshape(x.shape)
    assert np.allclose(z, (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-8))


def test_wide_merge_has_bounded_groups(spark):
    """Many ranges of one wide instance are added up in two steps."""
    inst, _, bg = setup(spark, 10, n=1)
    model = Model(tuple(np.linspace(-0.5, 0.5, 10)), 0.1)
    many = explain(inst, model, bg, n_samples=3000, chunk=10, partitions=8).first()
    one = explain(inst, model, bg, n_samples=3000).first()
    assert many.n_samples == 3000 and np.allclose(many.coeff, one.coeff, atol=1e-10)
