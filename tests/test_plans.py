"""Plans that move little: the split, the sweep, agreement between seeds and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.functions import draws
from localexplain.operators import agree, moments, prep, report, timings, validate
from localexplain.operators.fit import local_delta
from localexplain.plans import compare, sweep
from localexplain.plans import explain as ex
from localexplain.plans import queries as q
from localexplain.sources import tables
from localexplain.sources.models import Model


def q_folder():
    return "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_split_never_moves_rows(spark, sf):
    events = q.read(spark, sf, "events").selectExpr("event_id AS row_id", "event_type AS label", "value")
    text = plan(prep.stratified_split(events))
    assert "Exchange hashpartitioning" not in text and "Window" not in text and "BroadcastHashJoin" in text


def test_split_of_many_classes_and_clashing_names(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS row_id", "id % 200 AS label", "1 AS quota", "2 AS need", "3 AS h", "4 AS c", "5 AS after")
    few = {(r.row_id, r.split) for r in prep.stratified_split(rows).collect()}
    monkeypatch.setattr(prep, "MOST_CLASSES", 10)
    many = prep.stratified_split(rows)
    assert {(r.row_id, r.split) for r in many.collect()} == few and len(few) == 3000
    assert {r["count"] for r in many.where("split = 'test'").groupBy("label").count().collect()} == {3}
    assert prep.stratified_split(rows.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [16384, 8])
def test_sweep_equals_single_explanations(spark, chunk):
    rng = np.random.default_rng(1)
    inst = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(12)], "instance_id BIGINT, x0 ARRAY<DOUBLE>")
    model, bg = Model(tuple(rng.normal(size=5)), 0.1), rng.normal(size=5).tolist()
    for solver in ("cholesky", "adam"):
        got = {(r.D, r.B, r.run): r for r in sweep.sweep_fidelity(inst, model, bg, [5, 2], [20, 50, 31], 2, seed=9, solver=solver, chunk=chunk).collect()}
        assert len(got) == 12
        for (d, b, run), r in got.items():
            cut = inst.withColumn("x0", F.slice("x0", 1, d))
            want = ex.explain(cut, Model(model.w[:d], model.bias), bg[:d], n_samples=b, seed=9 + run, solver=solver)
            mean = want.agg(F.avg("r2").alias("r2"), F.avg(local_delta()).alias("delta"), F.count(F.lit(1)).alias("n")).first()
            assert (abs(r.mean_r2 - mean.r2) < 1e-9, abs(r.mean_delta - mean.delta) < 1e-9, r.n) == (True, True, mean.n)


def test_sweep_reads_its_table_once(spark, sf):
    inst, model, bg = q.lines(spark, sf)
    text = plan(sweep.sweep_fidelity(inst, model, bg, [2, 3, 4], [16, 32, 64], 6))
    # the table's own grouping, the instances, and the sums of the grid's few rows
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 3


def test_sweep_of_nothing_and_bad_grids(spark):
    inst = spark.createDataFrame([], "instance_id BIGINT, x0 ARRAY<DOUBLE>")
    model = Model((1.0, 2.0), 0.0)
    got = sweep.sweep_fidelity(inst, model, [0.0, 0.0], [1, 2], [4], 2).collect()
    assert len(got) == 4 and all(r.n == 0 and r.mean_r2 is None for r in got)
    for grid in (([], [4], 1), ([1], [], 1), ([1], [4], 0), ([3], [4], 1)):
        with pytest.raises(ValueError):
            sweep.sweep_fidelity(inst, model, [0.0, 0.0], *grid)


def test_seeds_are_compared_where_they_are_summed(spark, sf):
    inst, model, bg = q.parts(spark, sf)
    df = compare.compare_seeds(inst, model, bg, {"a": 1, "b": 2}, n_samples=16)
    text = plan(df)
    assert text.count("Exchange") == 1 and "SortAggregate" not in text
    wide, wide_model, wide_bg = q.embeddings(spark, sf)
    text = plan(compare.compare_seeds(wide, wide_model, wide_bg, {"a": 1, "b": 2}, n_samples=16))
    assert text.count("Exchange") == 1 and "Aggregate" not in text


@pytest.mark.parametrize("k", [0, 1, 3])
def test_seeds_compare_as_stored_fits_do(spark, sf, k):
    inst, model, bg = q.parts(spark, sf)
    names = {"a": 1, "b": 2, "c": 3}
    got = compare.compare_seeds(inst, model, bg, names, k=k, n_samples=16, solver="gd").toPandas()
    fits = {n: ex.explain(inst, model, bg, n_samples=16, seed=s, solver="gd") for n, s in names.items()}
    want = agree.compare_pairs(tables.load_fits(fits), list(names), k=k).toPandas()
    order = ["instance_id", "source_a", "source_b"]
    got, want = (t.sort_values(order, ignore_index=True) for t in (got, want))
    assert got[order].equals(want[order])
    for c in want.columns[3:]:
        assert np.allclose(got[c], want[c], atol=1e-9), c
    with pytest.raises(ValueError, match="two sources or more"):
        compare.compare_seeds(inst, model, bg, {"a": 1})


def test_histograms_of_several_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b) if i % 5 else None, 2.0, None) for i, (a, b) in enumerate(zip(rng.normal(size=400), rng.exponential(size=400)))]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE").repartition(4)
    got = validate.diff_histograms(df, ["a", "b", "c", "d"]).toPandas()
    assert set(got.name) == {"a", "b", "c"}
    for i, name in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None]
        counts, edges = np.histogram(values, bins=8)
        mine = got[got.name == name].sort_values("bin")
        assert mine.n.tolist() == counts.tolist() and np.allclose(mine.lo, edges[:-1]) and np.allclose(mine.hi, edges[1:])
        assert mine.bar.tolist() == [int(40 * c / counts.max()) for c in counts]
    assert validate.diff_histograms(df.where("false"), ["a"]).count() == 0
    # one pass for all ranges, one for all counts
    assert plan(validate.diff_histograms(q.read(spark, q_folder(), "lineitem"), ["l_tax", "l_discount"])).count("FileScan") <= 3


def test_stored_scores_are_not_made_again(spark, sf):
    inst, model, bg = q.parts(spark, sf)
    scored = ex.scored_samples(inst, model, bg, n_samples=20).select("instance_id", "sample_id", "x", "z", "pred", "weight")
    same = ex.explain(inst, model, bg, samples=scored, stored_scores=True).orderBy("instance_id").toPandas()
    want = ex.explain(inst, model, bg, n_samples=20).orderBy("instance_id").toPandas()
    assert np.allclose(np.stack(same.coeff), np.stack(want.coeff), atol=1e-8) and np.allclose(same.r2, want.r2, atol=1e-8)
    other = ex.explain(inst, model, bg, samples=scored.withColumn("pred", F.lit(0.5)), stored_scores=True)
    assert np.allclose(np.stack(other.toPandas().coeff), 0, atol=1e-3)
    with pytest.raises(ValueError, match="stored scores need"):
        ex.explain(inst, model, bg, samples=scored.drop("weight"), stored_scores=True)
    for column in ("pred", "weight"):
        holes = scored.withColumn(column, F.when(F.col("sample_id") > 3, F.col(column)))
        with pytest.raises(Exception, match="a sample without pred or weight"):
            ex.explain(inst, model, bg, samples=holes, stored_scores=True).collect()


def test_equal_features_and_no_ridge_have_a_fit(spark, sf):
    got = q.QUERIES["fit_singular"](spark, sf).toPandas()
    assert np.isfinite(got.coefficient).all() and np.isfinite(got.intercept).all() and set(got.solver) == {"cholesky"}


def test_values_of_a_grid(spark):
    df = spark.createDataFrame([(512, 9), (128, 10), (512, 9), (None, 4)], "D INT, B INT")
    assert tuple(timings.grid_values(df).first()) == ([128, 512], [4, 9, 10])
    assert tuple(timings.grid_values(df.where("false")).first()) == ([], [])


def test_repeated_fits_of_a_source_are_an_error(spark):
    fit_row = ("array(1D, 2D) AS coeff", "0D AS intercept", "0D AS r2", "0D AS surr_x0")
    fits = spark.range(2).selectExpr("id AS instance_id", "'a' AS source", *fit_row)
    other = spark.range(1).selectExpr("id AS instance_id", "'b' AS source", *fit_row)
    assert agree.compare_pairs(fits.unionAll(other), ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="several fits of one source"):
        agree.compare_pairs(fits.unionAll(other).unionAll(fits), ["a", "b"]).collect()
    text = plan(agree.by_source(fits, ["a", "b"]))
    assert "SortAggregate" not in text


def test_narrow_fits_are_solved_where_their_sums_are_made(spark, sf):
    """No aggregation over samples, and sums never leave the worker: one Arrow step, also for the second pass of a curve."""
    inst, model, bg = q.lines(spark, sf)
    table = plan(inst).count("HashAggregate")
    text = plan(ex.explain(inst, model, bg, n_samples=16))
    assert text.count("HashAggregate") == table and text.count("MapInArrow") == 1 and "Generate" not in text
    fits = ex.explain(inst, model, bg, n_samples=16)
    text = plan(report.ablation_curve(fits, model, bg, n_samples=16))
    assert text.count("HashAggregate") == table and text.count("MapInArrow") == 2


@pytest.mark.parametrize("d", [1, 2, 5, 8, 9])
def test_blocks_of_narrow_samples_hold_the_same_draws_and_sums(d):
    pick = np.random.default_rng(d)
    x0, means, w = pick.normal(size=(6, d)), pick.normal(size=d), pick.random((6, 40))
    keys = draws.sample_keys(-3, pick.integers(-(10**12), 10**12, 6), np.arange(40))
    off, masked = draws.draw_offsets(keys, x0, means, 0.3, 0.1)
    f = np.arange(d)
    assert np.array_equal(masked, draws.words(keys, 4 * (f // 2) + f % 2) < 0.3 * 2.0**32) and masked.shape == (6, 40, d)
    assert np.array_equal(off[masked], np.broadcast_to((means - x0)[:, None], off.shape)[masked])
    r = np.sqrt(-2 * np.log((draws.words(keys, 4 * (f // 2) + 2) + 1.0) / 2**32))
    a = draws.words(keys, 4 * (f // 2) + 3) * (2 * np.pi / 2**32)
    assert np.allclose(off[~masked], (0.1 * r * np.where(f % 2, np.sin(a), np.cos(a)))[~masked], rtol=1e-12, atol=0)
    assert np.allclose(draws.squared(off), (off * off).sum(2), rtol=1e-13)
    assert np.allclose(draws.along(off, means), off @ means) and np.allclose(draws.along(off, x0), np.einsum("mbd,md->mb", off, x0))
    y, s = pick.normal(size=(6, 40)), moments.HEAD
    got = moments.block_sums(off, w, y)
    assert got.shape == (6, moments.size_of(d)) and np.allclose(got[:, :s], np.stack([np.full(6, 40.0), w.sum(1), (w * y).sum(1), (w * y * y).sum(1)], 1))
    gram = np.einsum("mb,mbi,mbj->mij", w, off, off)[:, *np.triu_indices(d)]
    weighted = off * w[..., None]
    parts = [off.sum(1), (off * off).sum(1), weighted.sum(1), (weighted * y[..., None]).sum(1), gram]
    assert np.allclose(got[:, s:], np.concatenate(parts, 1))
