import numpy as np
import pytest
from brute import stack

from localexplain.functions import draws
from localexplain.operators.perturb import perturb, to_long
from localexplain.sources.models import synthetic_background, synthetic_instances


def test_words_equal_the_builtin_hash(spark):
    ids = np.array([0, 1, 7, 2**31, 2**40 + 3, -5, -(2**50)], dtype=np.int64)
    rows = spark.createDataFrame([(int(i), s) for i in ids for s in range(5)], "instance_id BIGINT, sample_id INT")
    for seed in (1234, -17, 2**31 - 1):
        got = rows.selectExpr(
            "instance_id", "sample_id", f"{draws.sample_key(seed)} AS k", f"hash(4, {draws.sample_key(seed)}) + {draws.TWO_31}L AS w"
        ).collect()
        keys = draws.sample_keys(seed, ids, np.arange(5))
        words = draws.words(keys, np.array([0, 4]))
        at = {int(v): i for i, v in enumerate(ids)}
        for r in got:
            high, low = keys[:, at[r.instance_id], r.sample_id].tolist()
            assert (high << 32 | low) == r.k % 2**64
            assert words[at[r.instance_id], r.sample_id, 1] == r.w


def test_rows_of_draws_do_not_recur():
    """Among ten million samples of a million instances all keys differ, and where one word is equal the others are not."""
    keys = draws.sample_keys(1234, np.arange(1_000_000) * 10 + 3, np.arange(10)).reshape(2, -1)
    whole = keys[0].astype(np.uint64) << np.uint64(32) | keys[1]
    assert len(np.unique(whole)) == 10_000_000
    first = draws.words(keys, np.array([0]))[:, 0]
    order = np.argsort(first, kind="stable")
    same = np.flatnonzero(first[order][1:] == first[order][:-1])
    assert len(same) > 1000  # 32 bits do recur
    a, b = (draws.words(keys[:, order[same + i]], np.array([2, 3])) for i in (0, 1))
    assert not (a == b).all(1).any()


def test_seed_must_fit():
    with pytest.raises(ValueError):
        draws.sample_key(2**31)


@pytest.mark.parametrize("d", [1, 4, 13])
def test_layouts_partitions_and_ranges_agree(spark, d):
    inst, bg = synthetic_instances(spark, d, n=6), synthetic_background(d)
    base = stack(perturb(inst, bg, 40), "x")
    assert np.array_equal(base, stack(perturb(inst.coalesce(1), bg, 40, partitions=3), "x"))
    assert np.array_equal(base, stack(perturb(inst, bg, 40, chunk=7), "x"))
    long = perturb(inst, bg, 40, layout="long").toPandas().sort_values(["instance_id", "sample_id", "feature_idx"])
    assert np.allclose(base.ravel(), long["x"].to_numpy(), rtol=0, atol=1e-14)
    z = to_long(perturb(inst, bg, 40)).toPandas().sort_values(["instance_id", "sample_id", "feature_idx"])["z"]
    assert np.array_equal(z.to_numpy(), long["z"].to_numpy())
    off, masked = draws.draw_offsets(
        draws.sample_keys(1234, np.arange(6), np.arange(40)), stack(inst.selectExpr("*", "0 AS sample_id"), "x0")[:, 0], np.array(bg), 0.2, 0.1
    )
    x0 = stack(inst.selectExpr("*", "0 AS sample_id"), "x0")
    assert np.allclose(base, x0 + off, atol=1e-14)


def test_equal_seed_equal_samples_other_seed_other_samples(spark):
    inst, bg = synthetic_instances(spark, 3, n=2), synthetic_background(3)
    a, b, c = (stack(perturb(inst, bg, 20, seed=s), "x") for s in (5, 5, 6))
    assert np.array_equal(a, b) and not np.array_equal(a, c)


def test_cells_are_independent_and_normal(spark):
    """The mask rate is mask_prob, noise is standard normal, features and samples do not share draws."""
    d, n = 6, 20000
    inst = synthetic_instances(spark, d, flat_x0=True)
    samples = perturb(inst, [0.5] * d, n, mask_prob=0.2, noise_std=0.1, chunk=4096)
    x, z = stack(samples, "x")[0], stack(samples, "z")[0]
    assert abs((z == 0).mean() - 0.2) < 0.005
    assert np.abs(np.corrcoef(z.T) - np.eye(d)).max() < 0.03
    noise = (stack(perturb(inst, [0.5] * d, n, mask_prob=0.0, chunk=4096), "x")[0] - 0.5) / 0.1
    assert np.abs(noise.mean(0)).max() < 0.03 and np.abs(noise.std(0) - 1).max() < 0.03
    assert np.abs(np.corrcoef(noise.T) - np.eye(d)).max() < 0.03
    assert np.linalg.matrix_rank(np.c_[np.ones(n), x]) == d + 1
    assert np.abs(np.corrcoef(noise[1:, 0], noise[:-1, 0])[0, 1]) < 0.03
    assert 0.0024 < (np.abs(noise) > 3).mean() < 0.0030


@pytest.mark.parametrize("x0", ["NULL", "array(1D)", "array(1D, 2D, 3D)", "array(1D, NULL)", "array(1D, double('NaN'))"])
def test_bad_instances_raise(spark, x0):
    bad = spark.range(1).selectExpr("id AS instance_id", f"{x0} AS x0")
    with pytest.raises(Exception, match="must hold 2 finite values"):
        perturb(bad, [0.5, 0.5], 4).collect()


def test_masked_everywhere_and_nowhere(spark):
    inst, bg = synthetic_instances(spark, 3), [0.25, 0.5, 0.75]
    assert np.array_equal(stack(perturb(inst, bg, 5, mask_prob=1.0), "x")[0], np.tile(bg, (5, 1)))
    assert (stack(perturb(inst, bg, 50, mask_prob=0.0), "z") == 1).all()
    with pytest.raises(ValueError):
        perturb(inst, bg, 0)
    with pytest.raises(ValueError):
        perturb(inst, bg, 5, layout="diagonal")
