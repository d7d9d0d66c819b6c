"""Replays, bundles, z-scores and ranges at any number of instances: nothing broadcast, nothing moved twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.operators import fit, moments
from localexplain.operators.perturb import INSTANCES_PER_TASK, perturb, range_size
from localexplain.operators.score import score_at_x0
from localexplain.plans import queries as q
from localexplain.plans.explain import explain, scored_samples
from localexplain.sources.models import by_feature
from test_fit import by_key, setup
from test_plans import plan

REPLAYS = ["replay_check", "replay_scores", "bundle_outputs", "zscore_cells", "fit_replayed", "fit_singular", "fit_stored"]
CHECKS = ["damage_tolerance", "damage_verdict", "tolerance_report", "verdict"]


@pytest.mark.parametrize("name", REPLAYS + CHECKS)
def test_rows_made_from_instances_are_never_broadcast(spark, sf, name):
    text = plan(q.QUERIES[name](spark, sf))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and "BroadcastExchange" not in text


def test_histogram_broadcasts_its_ranges_alone(spark, sf):
    # one join for the ranges, one for the counts of bins, each with two rows per column and bin at most
    text = plan(q.QUERIES["diff_histogram"](spark, sf))
    assert "BroadcastHashJoin [instance_id" not in text and "SortMergeJoin [instance_id" in text


def test_wide_replay_moves_its_samples_once(spark, sf):
    text = plan(q.QUERIES["fit_replayed_wide"](spark, sf))
    assert "_salt" in text and "Exchange hashpartitioning(instance_id#" in text
    assert "salt" not in [part for line in text.splitlines() if "REPARTITION" in line for part in line.replace("#", " ").replace("(", " ").split()]


def test_wide_replay_leaves_its_samples_where_they_are_made(spark, sf):
    # a shuffle above the draws would move B vectors of every instance: only instance rows and sums are moved
    lines = plan(q.QUERIES["fit_replayed_wide"](spark, sf)).splitlines()
    (join,) = [i for i, line in enumerate(lines) if "Join [" in line]
    depth = lines[join].index("ShuffledHashJoin")
    (right,) = [i for i in range(join + 1, len(lines)) if lines[i][depth : depth + 3] == "+- "]
    left = [line.strip(" :+-").split()[0] for line in lines[join + 1 : right]]
    assert left.count("Exchange") == 1 and "MapInArrow" not in left
    assert left.index("Generate") < left.index("ArrowWindowPython") < left.index("Exchange") and "Sort" not in left[: left.index("ArrowWindowPython")]


@pytest.mark.parametrize("d, b", [(3, 50), (16, 50), (16, 9000), (300, 4100)])
def test_salted_samples_are_the_same_rows(spark, d, b):
    inst, model, bg = setup(spark, d, n=3)
    inst = inst.withColumn("tag", F.expr("string(instance_id)"))
    plain, placed = (perturb(inst, bg, b, salted=s) for s in (False, True))
    assert placed.columns == ["instance_id", "x0", "tag", "_salt", "sample_id", "x", "z"]
    assert plain.exceptAll(placed.drop("_salt")).isEmpty() and placed.count() == 3 * b
    want, got = (by_key(explain(inst, model, samples=p.drop("x0", "tag"))) for p in (plain, placed))
    assert want.keys() == got.keys() and len(got) == 3
    assert all(got[i].n_samples == b and np.allclose(got[i].coeff, want[i].coeff, rtol=1e-9, atol=1e-12) for i in got)


@pytest.mark.parametrize("d", [3, 16])
def test_salted_samples_find_the_same_errors(spark, d):
    inst, model, bg = setup(spark, d, n=3)
    stored = perturb(inst, bg, 50, salted=True).drop("x0")
    with pytest.raises(Exception, match="no instance for the samples of 2"):
        explain(inst.where("instance_id < 2"), model, samples=stored).collect()
    with pytest.raises(Exception, match="instance 1 occurs more than once"):
        perturb(inst.unionAll(inst.where("instance_id = 1")), bg, 50, salted=True).collect()
    with pytest.raises(ValueError, match="partitions=0"):
        perturb(inst, bg, 50, salted=True, partitions=0)
    # sets of one salt and of two: no sample gets lost unseen, and without the column they are joined as any others
    both = stored.where("instance_id < 2").unionAll(perturb(inst.where("instance_id = 2"), bg, 5000, salted=True).drop("x0"))
    with pytest.raises(Exception, match="other salts"):
        explain(inst, model, samples=both).collect()
    fits = by_key(explain(inst, model, samples=both.drop("_salt")))
    assert [fits[i].n_samples for i in range(3)] == [50, 50, 5000]
    # moved since, they are joined again
    moved = by_key(explain(inst, model, samples=stored.repartition(3)))
    assert [moved[i].n_samples for i in range(3)] == [50, 50, 50]


@pytest.mark.parametrize("d", [3, 11])
def test_runs_of_samples_add_up_like_dealt_ones(spark, d):
    inst, model, bg = setup(spark, d)
    stored = perturb(inst, bg, 50).select("instance_id", "sample_id", "x", "z")
    rows = scored_samples(score_at_x0(inst, model), model, samples=stored)
    plain, runs = (sums(moments.sample_moments(rows, d, in_runs=r)) for r in (False, True))
    assert plain.keys() == runs.keys() and all(np.allclose(plain[i], runs[i], rtol=1e-12, atol=1e-12) for i in plain)


def sums(df):
    return {r.instance_id: np.array(r.s) for r in df.collect()}


@pytest.mark.parametrize("d", [3, 11])
def test_many_instances_stay_whole(spark, d):
    inst, model, bg = setup(spark, d, n=2 * INSTANCES_PER_TASK)
    assert range_size(inst, 50, 8, 2) == 50 and range_size(inst, 50, 8, 3) == 8 and range_size(inst, 8, 8, 2) == 8
    whole, ranges = explain(inst, model, bg, n_samples=50, partitions=2), explain(inst, model, bg, n_samples=50, chunk=8, partitions=2)
    assert plan(ranges).count("Exchange") == plan(whole).count("Exchange") == 1
    few = explain(inst, model, bg, n_samples=50, chunk=8, partitions=3)
    assert plan(few).count("Exchange") > 1
    a, b, c = by_key(whole), by_key(ranges), by_key(few)
    assert a.keys() == b.keys() == c.keys() and len(a) == 2 * INSTANCES_PER_TASK
    for i in a:
        assert np.allclose(a[i].coeff, b[i].coeff, atol=1e-9) and np.allclose(a[i].coeff, c[i].coeff, atol=1e-9)


def test_blocks_of_sums_and_systems_stay_small():
    # a worker holds several arrays of a block at a time, and an executor several workers
    assert 8 * moments.size_of(64) * moments.rows_per_batch(64) <= 8 << 20 and 8 * fit.FLOATS_PER_STACK <= 8 << 20
    assert moments.rows_per_batch(64) >= 256


def test_background_is_read_once(spark, sf):
    inst = q.line_instances(spark, sf)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    counted = inst.mapInArrow(count, inst.schema)
    assert q.background_of(counted, 4) == q.background_of(inst, 4) and seen.value == inst.count()
    means = spark.createDataFrame([(i, float(i)) for i in range(3)], "feature_idx INT, mean DOUBLE")
    assert by_feature(means, "mean", 3, "it") == [0.0, 1.0, 2.0]
    more = means.unionAll(means)
    wrong = [means.where("feature_idx > 0"), more, means.selectExpr("feature_idx + 1 AS feature_idx", "mean")]
    wrong += [means.selectExpr("feature_idx", "if(mean > 1, NULL, mean) AS mean"), means.selectExpr("if(mean > 1, NULL, feature_idx) AS feature_idx", "mean")]
    for rows in wrong:
        with pytest.raises(ValueError, match="does not hold features"):
            by_feature(rows, "mean", 3, "it")


def test_sources_are_fitted_in_one_pass(spark, sf):
    inst, model, bg = setup(spark, 3)
    made = moments.perturbed_moments(inst, model, bg, 50, 0.2, 0.1, 1.0, 1234)
    given = {"a": {}, "b": {"ridge": 10.0}, "c": {"solver": "gd", "gd_iters": 20}}
    together = fit.fit_sources(made, given)
    for name, arguments in given.items():
        want, got = by_key(fit.fit(made, **arguments)), by_key(together.where(f"source = '{name}'").drop("source"))
        assert want == got and len(want) == 4
    with pytest.raises(ValueError):
        fit.fit_sources(made, {})
    # the table, the instances and the fits by instance: each is shuffled once
    text = plan(q.QUERIES["side_by_side"](spark, sf))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 3
