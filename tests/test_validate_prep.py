import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.operators import prep, validate
from localexplain.operators.perturb import perturb
from localexplain.operators.score import score_at_x0
from localexplain.plans.explain import scored_samples
from localexplain.sources import models
from localexplain.sources.models import Model, synthetic_params


@pytest.fixture(scope="module")
def stored(spark):
    model, bg, inst = synthetic_params(spark, 5)
    scored = scored_samples(inst, model, bg, n_samples=100)
    return scored.select("instance_id", "sample_id", "x", "z", "pred", "weight"), inst, model, bg


def test_clean_samples_pass(stored):
    samples, inst, model, bg = stored
    replay = validate.replay_check(samples, inst, model)
    report = {r.name: r for r in validate.tolerance_report(replay).collect()}
    assert report["preds"].passed and report["weights"].passed and report["preds"].n == 100
    assert validate.verdict(
        validate.tolerance_report(replay), validate.shape_check(samples, inst, 100), validate.mask_checks(samples, bg)
    ).first().passed


def test_each_damage_is_found(stored):
    samples, inst, model, bg = stored
    off = samples.withColumn("pred", F.col("pred") + F.when(F.col("sample_id") == 7, 0.01).otherwise(0.0))
    replay = validate.replay_check(off, inst, model)
    report = {r.name: r for r in validate.tolerance_report(replay).collect()}
    assert not report["preds"].passed and report["weights"].passed and abs(report["preds"].max_diff - 0.01) < 1e-9
    assert all(r.passed for r in validate.tolerance_report(replay, tol=0.02).collect())
    nan = samples.withColumn("pred", F.when(F.col("sample_id") == 7, F.lit(None)).otherwise(F.col("pred")))
    assert not {r.name: r for r in validate.tolerance_report(validate.replay_check(nan, inst, model)).collect()}["preds"].passed

    short = validate.shape_check(samples.where("sample_id < 99"), inst, 100).first()
    assert short.n_found == 99 and not short.passed
    assert validate.shape_check(samples.where("false"), inst, 100).first().n_found == 0

    bad = samples.withColumn("z", F.when(F.col("sample_id") == 0, F.array(*[F.lit(2)] * 5)).otherwise(F.col("z")))
    row = validate.mask_checks(bad, bg).first()
    assert row.bad_mask == 5 and not row.passed
    moved = samples.withColumn("x", F.transform("x", lambda v: v + 1e-9))
    row = validate.mask_checks(moved, bg).first()
    assert row.bad_value == row.masked > 0 and row.cells == 500
    verdict = validate.verdict(
        validate.tolerance_report(validate.replay_check(samples, inst, model)), validate.shape_check(samples, inst, 100),
        validate.mask_checks(moved, bg),
    ).first()
    assert not verdict.passed and verdict.checks == 3


@pytest.mark.parametrize("values", [[0.0, 0.1, 0.2, 0.9, 1.0, 1.0], [3.0, 3.0], [-2 + 0.125 * i for i in range(57)]])
def test_histogram_like_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    rows = validate.diff_histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=8)
    assert [r.n for r in rows] == counts.tolist()
    assert np.allclose([r.lo for r in rows], edges[:-1]) and np.allclose([r.hi for r in rows], edges[1:])
    assert [r.bar for r in rows] == [int(40 * c / counts.max()) for c in counts]


def test_split_is_exact_disjoint_and_stable(spark):
    rows = spark.range(5003).selectExpr("id AS row_id", "CASE WHEN id % 50 = 0 THEN 'rare' WHEN id = 3 THEN 'one' ELSE 'hot' END AS label")
    split = prep.stratified_split(rows)
    got = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    total = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    for label, n in total.items():
        assert got.get((label, "test"), 0) == round(0.2 * n)
        assert got.get((label, "test"), 0) + got.get((label, "train"), 0) == n
    assert split.select("row_id").distinct().count() == 5003
    again = prep.stratified_split(rows.repartition(3)).where("split = 'test'")
    assert again.join(split.where("split = 'test'"), "row_id").count() == again.count()
    other = prep.stratified_split(rows, seed=1).where("split = 'test'")
    assert other.join(again, "row_id").count() < again.count()
    everything = prep.stratified_split(rows, test=1.0)
    assert everything.where("split = 'test'").count() == 5003
    assert prep.stratified_split(rows, test=0.0).where("split = 'test'").count() == 0


def test_split_of_null_labels(spark):
    rows = spark.range(100).selectExpr("id AS row_id", "if(id < 40, NULL, 1) AS label")
    got = {r.label: r["count"] for r in prep.stratified_split(rows).where("split = 'test'").groupBy("label").count().collect()}
    assert got == {None: 8, 1: 12}


def test_select_instances(spark):
    rows = spark.range(1000).selectExpr("id AS row_id", "id * 2 AS v")
    every = prep.select_instances(rows, list(range(1000)))
    assert sorted(r.position for r in every.collect()) == list(range(1000))
    at = {r.position: r.row_id for r in every.collect()}
    some = {r.position: r.row_id for r in prep.select_instances(rows, [0, 30, 999]).collect()}
    assert some == {p: at[p] for p in (0, 30, 999)}
    for bad in (1000, -1):
        with pytest.raises(ValueError, match="no row stands at"):
            prep.select_instances(rows, [bad])


def test_training_reaches_the_minimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2]
    y = (x @ [1.5, -0.3, 2.0] + 0.4 + rng.logistic(size=400) > 0).astype(int)
    train = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "x ARRAY<DOUBLE>, label INT")
    model = prep.train_black_box(train, c=1.0)
    w, b = np.zeros(3), 0.0
    for _ in range(50):  # Newton on sum of losses + |w|^2 / 2, intercept unpenalised
        p = 1 / (1 + np.exp(-(x @ w + b)))
        xa = np.c_[x, np.ones(400)]
        grad = xa.T @ (p - y) + np.r_[w, 0.0]
        hess = (xa * (p * (1 - p))[:, None]).T @ xa + np.diag([1.0, 1.0, 1.0, 0.0])
        step = np.linalg.solve(hess, grad)
        w, b = w - step[:3], b - step[3]
    assert np.allclose(model.w, w, atol=1e-4) and abs(model.bias - b) < 1e-4
    hits = ((x @ w + b > 0).astype(int) == y).mean()
    assert abs(prep.accuracy(train, model).first().accuracy - hits) < 0.01
    with pytest.raises(ValueError):
        prep.train_black_box(train.where("false"))


def test_background_and_summary(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 0.5, [0, 1]), ([3.0, 5.0], 1.5, [1, 1])], "x ARRAY<DOUBLE>, p DOUBLE, z ARRAY<INT>")
    assert prep.as_vector(prep.background_means(rows, 2), 2) == [2.0, 3.5]
    with pytest.raises(ValueError):
        prep.as_vector(prep.background_means(rows.where("false"), 2), 2)
    got = {r.name: r for r in prep.vector_summary(rows, ["x", "p"], mask="z").collect()}
    assert (got["x"].min, got["x"].max, got["x"].mean, got["x"].n) == (1.0, 5.0, 2.75, 4)
    assert (got["p"].mean, got["p"].n) == (1.0, 2) and (got["z"].zeros, got["z"].ones) == (1, 3)


def test_synthetic_parameters(spark):
    model, bg, inst = models.synthetic_params(spark, 7)
    assert inst.first().x0 == [1.0, 0.5, 0.5, 0.5, 0.5, 1.0, 0.5] and bg == [0.5] * 7
    assert np.allclose(model.w, 0.02 * np.arange(1, 8)) and model.bias == -1.0
    assert models.synthetic_instances(spark, 3, flat_x0=True).first().x0 == [0.5] * 3
    expected = 1 / (1 + np.exp(1.0 - np.dot(model.w, inst.first().x0)))
    assert abs(score_at_x0(inst, model).first().bb_x0 - expected) < 1e-12


def test_dataset_by_name(spark, sf):
    specs = {"parts": (f"{sf}/part.parquet", "p_partkey", ["p_size", "p_retailprice"], "int(p_size <> 1)")}
    row = models.load_dataset(spark, "parts", specs).first()
    assert len(row.x) == 2 and row.label in (0, 1)
    with pytest.raises(ValueError, match="no dataset"):
        models.load_dataset(spark, "iris", specs)


def test_perturbed_samples_of_a_model(spark):
    model = Model((1.0, -1.0), 0.0)
    assert model.d == 2
    inst = models.synthetic_instances(spark, 2)
    assert perturb(inst, [0.0, 0.0], 3).columns == ["instance_id", "x0", "sample_id", "x", "z"]
