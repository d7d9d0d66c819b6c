"""Training by Newton's method, the workflow on a trained model, black boxes on arrays, the fused second pass."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.operators import fit, moments, newton, prep, report, second_pass
from localexplain.operators.score import score, score_at_x0
from localexplain.plans import explain as ex
from localexplain.plans import workflow
from localexplain.sources.models import BatchModel, Model


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def training_rows(spark, n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=d) * 0.3 + 0.4 + rng.logistic(size=n) > 0).astype(int)
    return x, y, spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "x ARRAY<DOUBLE>, label INT").repartition(3)


def newton_by_hand(x, y, c):
    xa, beta = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-(xa @ beta)))
        beta = beta - np.linalg.solve((xa * (p * (1 - p))[:, None]).T @ xa + np.diag(ridge), xa.T @ (p - y) + ridge * beta)
    return beta


@pytest.mark.parametrize("d", [1, 3, 8, 9, 40])
def test_training_equals_newton_by_hand(spark, d):
    x, y, rows = training_rows(spark, 300, d)
    for c in (1.0, 0.01):
        beta, passes = newton.train_logistic(rows, d, c)
        assert np.allclose(beta, newton_by_hand(x, y, c), atol=1e-9) and passes < 12


def test_wide_and_narrow_sums_agree(spark):
    _, _, rows = training_rows(spark, 200, 5)
    beta = np.array([0.1, -0.2, 0.3, 0.0, 1.0, -1.0])
    checked = newton.checked(rows, 5)
    a, b = newton._narrow(checked, beta), newton._wide(checked, beta)
    assert (a.n, a.positives) == (b.n, b.positives) == (200, a.positives)
    assert np.allclose(a.gradient, b.gradient) and np.allclose(a.hessian, b.hessian) and abs(a.loss - b.loss) < 1e-9


def test_training_with_512_features(spark):
    x, y, rows = training_rows(spark, 700, 512)
    model = prep.train_black_box(rows, c=0.05)
    assert np.allclose([model.bias, *model.w], newton_by_hand(x, y, 0.05), atol=1e-9)


def test_separable_rows_and_large_values_converge(spark):
    rows = spark.createDataFrame([([v * 1000.0], int(v > 0)) for v in range(-20, 21) if v], "x ARRAY<DOUBLE>, label INT")
    beta, _ = newton.train_logistic(rows, 1, c=100.0)
    p = 1 / (1 + np.exp(-(beta[0] + beta[1] * 1000.0)))
    assert np.isfinite(beta).all() and p > 0.9


def test_rows_that_cannot_be_trained_on(spark):
    schema = "x ARRAY<DOUBLE>, label INT"
    one = [([1.0], 0), ([2.0], 1)]
    for bad in [(None, 0), ([1.0, 2.0], 0), ([None], 1), ([float("nan")], 1), ([1.0], None), ([1.0], 2)]:
        with pytest.raises(Exception, match="a training row needs 1 finite values"):
            prep.train_black_box(spark.createDataFrame([*one, bad], schema), d=1)
    with pytest.raises(ValueError, match="one class only"):
        prep.train_black_box(spark.createDataFrame([([1.0], 1), ([2.0], 1)], schema))


def test_a_pass_moves_only_sums(spark):
    _, _, rows = training_rows(spark, 50, 12)
    text = plan(newton.checked(rows.select("x", "label"), 12))
    assert "Window" not in text and "Join" not in text


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(30)]
    inst = spark.createDataFrame(rows, "instance_id BIGINT, x0 ARRAY<DOUBLE>").repartition(2)
    return inst, Model(tuple(rng.normal(size=12)), 0.2), rng.normal(size=12).tolist()


@pytest.mark.parametrize("chunk", [16384, 16])
def test_second_pass_equals_samples(spark, wide, chunk):
    inst, model, bg = wide
    fits = ex.explain(inst, model, bg, n_samples=50, solver=("cholesky", "adam"), epochs=20)
    sampling = {"n_samples": 50, "chunk": chunk}
    for normalized in (False, True):
        got = second_pass.refit_r2(fits, model, bg, normalized, **sampling).toPandas().sort_values(["instance_id", "solver"])
        rows = fit.surrogate_predict(ex.refit_samples(fits, model, bg, n_samples=50))
        want = fit.weighted_r2(rows, ("instance_id", "solver"), normalized).toPandas().sort_values(["instance_id", "solver"])
        assert len(got) == 60 and np.allclose(got.r2, want.r2) and np.allclose(got.sum_weights, want.sum_weights)
    got = second_pass.refit_curve(fits.where("solver = 'cholesky'"), model, bg, 5, **sampling).toPandas()
    data = ex.refit_samples(fits.where("solver = 'cholesky'"), model, bg, n_samples=50).toPandas()
    for i, rows in data.groupby("instance_id"):
        x, coeff, mean = np.stack(rows.x), np.array(rows.coeff.iloc[0]), np.array(rows.x_mean.iloc[0])
        for k in range(6):
            cut = x.copy()
            order = np.argsort(-np.abs(coeff), kind="stable")[:k]
            cut[:, order] = mean[order]
            error = (rows.weight * np.abs(cut @ coeff - rows.pred)).sum() / rows.weight.sum()
            assert abs(got[(got.instance_id == i) & (got.k == k)].wmae.iloc[0] - error) < 1e-9


def test_second_pass_of_wide_instances_keeps_no_samples(wide):
    inst, model, bg = wide
    fits = ex.explain(inst, model, bg, n_samples=50)
    for df in (second_pass.refit_r2(fits, model, bg, n_samples=50), report.ablation_curve(fits, model, bg, n_samples=50)):
        text = plan(df)
        assert not re.search(r"\b[xz]#|sample_id", text) and "Aggregate" not in text


def test_batch_model_equals_a_function_of_columns(spark, wide):
    def cubic(x):
        return 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] ** 3)))

    def columns(samples):
        return samples.withColumn("pred", F.expr("1D / (1D + exp(-(x[0] - x[1] * x[1] * x[1])))"))

    for d in (2, 12):
        inst = wide[0].withColumn("x0", F.slice("x0", 1, d))
        bg = wide[2][:d]
        got = ex.explain(inst, BatchModel(cubic, d), bg, n_samples=40).orderBy("instance_id").toPandas()
        want = ex.explain(inst, columns, bg, n_samples=40).orderBy("instance_id").toPandas()
        assert np.allclose(np.stack(got.coeff), np.stack(want.coeff), atol=1e-9) and np.allclose(got.r2, want.r2, atol=1e-9)
        scored = ex.scored_samples(inst, BatchModel(cubic, d), bg, n_samples=9).orderBy("instance_id", "sample_id").toPandas()
        want = ex.scored_samples(inst, columns, bg, n_samples=9).orderBy("instance_id", "sample_id").toPandas()
        assert np.allclose(scored.pred, want.pred) and np.allclose(scored.weight, want.weight)
        curve = report.ablation_curve(ex.explain(inst, BatchModel(cubic, d), bg, 40), BatchModel(cubic, d), bg, n_samples=40)
        assert curve.count() == 30 * (d + 1)


def test_batch_model_has_a_one_pass_plan_and_checks(spark, wide):
    inst, _, bg = wide
    assert plan(ex.explain(inst, BatchModel(lambda x: x[:, 0], 12), bg, n_samples=40)).count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="gave an array of shape"):
        ex.explain(inst, BatchModel(lambda x: x, 12), bg, n_samples=40).collect()
    big = np.zeros(9 << 20)
    with pytest.raises(ValueError, match="are broadcast"):
        score(score_at_x0(inst, Model((1.0,) * 12, 0.0)), BatchModel(lambda x: x[:, 0] + big[0], 12))
    with pytest.raises(ValueError, match="12 features"):
        ex.explain(inst, BatchModel(lambda x: x[:, 0], 12), bg[:3], n_samples=40)


def test_workflow_shares_one_model_and_one_pass(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    rows = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(x)], "row_id BIGINT, x ARRAY<DOUBLE>, label INT")
    train, test = rows.where("row_id < 60"), rows.where("row_id >= 60")
    calls = []

    def keep(df):
        calls.append(df)
        return df

    done = workflow.evaluate(train, test, k=2, n_samples=40, keep=keep)
    assert len(calls) == 1 and done.model.d == 3 and done.accuracy.first().n == 20
    got = workflow.long_report(done).toPandas()
    assert set(got.part) == {"r2", "delta", "pass", "cosine", "spearman", "overlap", "wmae"}
    assert len(got[got.part == "wmae"]) == 20 * 3 * 4 and len(got[got.part == "cosine"]) == 20 * 3
    curve = report.ablation_curve(ex.explain(test.selectExpr("row_id AS instance_id", "x AS x0"), done.model, done.background, 40), done.model, done.background, n_samples=40)
    mine = got[(got.part == "wmae") & (got.subject == "cholesky")].sort_values(["instance_id", "k"])
    assert np.allclose(mine.value, curve.orderBy("instance_id", "k").toPandas().wmae)


def test_sums_of_several_seeds_follow_each_other(spark, wide):
    inst, model, bg = wide
    for d in (3, 12):
        short, cut = inst.withColumn("x0", F.slice("x0", 1, d)), Model(model.w[:d], model.bias)
        for chunk in (16384, 16):
            both = moments.perturbed_moments(short, cut, bg[:d], 40, 0.2, 0.1, 1.0, [5, 6], chunk=chunk).orderBy("instance_id").toPandas()
            one = [moments.perturbed_moments(short, cut, bg[:d], 40, 0.2, 0.1, 1.0, s).orderBy("instance_id").toPandas() for s in (5, 6)]
            assert np.allclose(np.stack(both.s), np.concatenate([np.stack(o.s) for o in one], axis=1))
