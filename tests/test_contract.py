"""The same bad input is the same error on every path, and damaged stored data is found."""

import numpy as np
import pytest

from localexplain.operators import fit, moments, perturb, prep, timings, validate
from localexplain.plans import explain as ex
from localexplain.sources import models

PATHS = [(d, b) for d in (4, 10, 64) for b in (8, 40)]  # below and above one task row of 16 samples


def instances(spark, d, ids=(1, 2)):
    return spark.createDataFrame([(i, [0.1 * (i + f % 3) for f in range(d)]) for i in ids], "instance_id long, x0 array<double>")


@pytest.mark.parametrize("d, b", PATHS)
def test_repeated_ids_are_an_error(spark, d, b):
    model, bg = models.synthetic_model(d), models.synthetic_background(d)
    twice = instances(spark, d, (1, 2, 2))
    for plan in (ex.explain, ex.scored_samples):
        with pytest.raises(Exception, match="instance 2 occurs more than once"):
            plan(twice, model, bg, n_samples=b, chunk=16).collect()
    with pytest.raises(Exception, match="instance 2 occurs more than once"):
        perturb.perturb(twice, bg, b, chunk=16).collect()


@pytest.mark.parametrize("d, b", PATHS)
def test_lengths_and_width_are_checked_before_any_work(spark, d, b):
    rows, model, bg = instances(spark, d), models.synthetic_model(d), models.synthetic_background(d)
    for plan in (ex.explain, ex.scored_samples):
        with pytest.raises(ValueError, match="features"):
            plan(rows, models.synthetic_model(d - 1), bg, n_samples=b, chunk=16)
        for width in (0.0, -1.0, float("nan")):
            with pytest.raises(ValueError, match="kernel_width"):
                plan(rows, model, bg, n_samples=b, kernel_width=width, chunk=16)


def test_replay_of_an_unknown_instance_is_an_error(spark):
    rows, model = instances(spark, 2), models.synthetic_model(2)
    stored = spark.createDataFrame([(1, 0, [0.0, 1.0]), (9, 0, [0.0, 1.0])], "instance_id long, sample_id int, x array<double>")
    with pytest.raises(Exception, match="no instance for the samples of 9"):
        ex.scored_samples(rows, model, samples=stored).collect()


def test_means_of_any_other_length_are_an_error(spark):
    means = spark.range(70_000).selectExpr("int(id) AS feature_idx", "1D AS mean")
    assert len(prep.as_vector(means, 70_000)) == 70_000
    for bad in (means.where("feature_idx <> 3"), means.unionAll(means.limit(1)), means.selectExpr("feature_idx", "nullif(feature_idx, 5) * 1D AS mean")):
        with pytest.raises(ValueError, match="does not hold"):
            prep.as_vector(bad, 70_000)


def test_saved_model_with_conflicting_rows_is_an_error(spark, tmp_path):
    rows, model = instances(spark, 3), models.synthetic_model(3)
    models.write_model(model, [0.5] * 3, ["a", "b", "c"], rows, str(tmp_path))
    more = spark.createDataFrame([(i, 0.25) for i in range(3)], "feature_idx int, mean double")
    more.write.mode("append").parquet(f"{tmp_path}/background")
    with pytest.raises(ValueError, match="6 rows"):
        models.read_model(spark, str(tmp_path))


def test_wide_means_equal_narrow_ones(spark):
    rows = spark.createDataFrame([([1.0, 2.0, None] + [3.0] * 37,), ([5.0] * 40,), (None,), ([7.0],)], "x array<double>")
    wide = {r.feature_idx: r["mean"] for r in prep.background_means(rows, 40).collect()}
    narrow = {r.feature_idx: r["mean"] for r in prep.background_means(rows, 32).collect()}
    assert len(wide) == 40 and all(wide[f] == pytest.approx(narrow[f]) for f in narrow)
    empty = prep.background_means(rows.limit(0), 40).collect()
    assert len(empty) == 40 and all(r["mean"] is None for r in empty)


def test_ranges_of_one_instance_are_dealt_evenly(spark):
    ranges = perturb.spread(instances(spark, 2, (5,)), 2, 128, 8, 16)
    assert sorted(r["count"] for r in ranges.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()) == [1] * 8


def test_closed_form_descent_equals_the_steps():
    pick = np.random.default_rng(0)
    for d, n in ((1, 20), (3, 50), (12, 40)):
        x, w = pick.normal(size=(5, n, d)), pick.uniform(0.1, 1, (5, n))
        sums = moments.block_sums(x, w, pick.normal(size=(5, n)))
        system = fit.System(sums, pick.uniform(size=5), d)
        for ridge, iters, rate in ((1e-3, 500, 1e-2), (0.0, 300, 0.1), (10.0, 50, 0.5)):
            assert np.allclose(system.descend(ridge, iters, rate), system.descend_by_steps(ridge, iters, rate), atol=1e-10)
        assert np.allclose(system.descend(0.1, 9, 0.2, np.array([3])), system.descend_by_steps(0.1, 9, 0.2)[[3]])


def test_validation_finds_damage(spark):
    rows, model = instances(spark, 2), models.synthetic_model(2)
    good = ex.scored_samples(rows, model, [0.5, 0.5], n_samples=8).select("instance_id", "sample_id", "x", "z", "pred", "weight")

    def verdict(stored):
        report = validate.tolerance_report(validate.replay_check(stored, rows, model))
        parts = report, validate.shape_check(stored, rows, 8), validate.mask_checks(stored, [0.5, 0.5])
        return validate.verdict(*parts).first().passed

    assert verdict(good)
    unknown = good.selectExpr("instance_id + 70 AS instance_id", "sample_id", "x", "z", "0D AS pred", "0D AS weight")
    assert not verdict(good.unionAll(unknown))
    assert validate.tolerance_report(validate.replay_check(good.unionAll(unknown), rows, model)).first().unmatched == 16
    assert not verdict(good.selectExpr("instance_id", "if(sample_id = 7, 0, sample_id) AS sample_id", "x", "z", "pred", "weight"))
    assert not verdict(good.selectExpr("instance_id", "sample_id", "x", "if(sample_id = 2, array(NULL, 7), z) AS z", "pred", "weight"))
    assert not verdict(good.selectExpr("instance_id", "sample_id", "x", "z", "if(sample_id = 2, pred + 0.5, pred) AS pred", "weight"))
    assert verdict(good.selectExpr("instance_id", "sample_id", "x", "CAST(NULL AS array<int>) AS z", "pred", "weight"))


def test_means_without_first_runs_equal_dropping_them(spark):
    pick = np.random.default_rng(1)
    made = [("f", 0, i, int(d), 10, *map(float, pick.integers(1, 99, 4))) for i, d in enumerate(pick.choice([1, 1, 1, 2], 200))]
    made.append(("f", 0, 900, 3, 10, 1.0, 2.0, 3.0, 4.0))
    runs = spark.createDataFrame(made, "file string, chunk long, seq long, D int, B int, gen double, infer double, weights double, total double")
    for n in (0, 1, 2, 3):
        a = {r.D: r for r in timings.mean_by_key(timings.drop_first(runs, n)).collect()}
        b = {r.D: r for r in timings.mean_by_key(runs, n).collect()}
        assert set(a) == set(b) == {1, 2, 3}
        for d in a:
            assert a[d].runs == b[d].runs and all(a[d][s] == pytest.approx(b[d][s]) for s in timings.STAGES)
