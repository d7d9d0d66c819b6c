"""Hard negatives against brute force in Python's integers, and the bounds against true products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.llm import exact, hard_negatives
from localexplain.llm.hard_negatives import Rule

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(table, every=100, rule=Rule()):
    rows = {
        (i, tuple(math.floor(256 * x) for x in v), label)
        for i, v, label in table
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a, va, la in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label == la) for i, v, label in rows if i != a and len(v) == len(va))
        for s, p, _ in [r for r in scored if r[2]][: rule.positives]:
            inside = [(i, t) for t, i, same in scored if not same and rule.low * -s <= 100 * -t <= rule.high * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (i, t) in enumerate(inside[: rule.negatives])]
    return sorted(out)


def table_of(pick, n, size, spread, labels=4, scale=1.0, ids=1):
    centres = pick.normal(size=(6, size))
    x = (centres[pick.integers(0, 6, n)] + spread * pick.normal(size=(n, size))) * scale
    return [(i * ids, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, pick.integers(0, labels, n)))]


@pytest.fixture(scope="module")
def table():
    pick = np.random.default_rng(7)
    rows = table_of(pick, 700, 8, 0.4)
    rows += [(1000 + i, rows[50][1], i % 2) for i in range(200)]  # copies of one vector with two labels
    rows += [(2000, None, 0), (2100, [float("nan")] + [1.0] * 7, 0), (2200, [None] + [1.0] * 7, 0), (2300, [1.0] * 8, None)]
    rows += [(None, rows[3][1], 0), (2400, [0.0] * 8, 1), (2500, [float("inf")] * 8, 1), (100, rows[100][1], rows[100][2])]
    rows += [(3000, [1.0, 2.0], 0), (3001, [2.0, 2.0], 0), (3002, [1.0, 1.0], 1), (3100, [], 0), (3101, [], 1), (3102, [], 0)]
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 30])
def test_equals_brute_force(spark, table, cell_rows):
    frame = spark.createDataFrame(table, SCHEMA).repartition(5)
    for name in ("v", "ids", "score", "size", "ref", "part", "row", "norm", "lows"):
        frame = frame.withColumn(name, F.lit(7))
    got = sorted(tuple(r) for r in hard_negatives.mine(frame, cell_rows=cell_rows).collect())
    expected = plain(table)
    assert len(expected) > 200 and got == expected


def test_components_beyond_doubles_whole_numbers(spark):
    pick = np.random.default_rng(8)
    table = [(25 * i, v, label) for i, v, label in table_of(pick, 60, 5, 0.2, labels=2, scale=3e6)]
    assert max(max(map(abs, v)) for _, v, _ in table) * 256 > 2**30
    got = sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(table, SCHEMA), rule=Rule(3, 4)).collect())
    assert got == plain(table, rule=Rule(3, 4)) and max(r[4] for r in got) > 2**53


def test_empty_and_one_label(spark, table):
    frame = spark.createDataFrame(table, SCHEMA)
    assert hard_negatives.mine(frame.limit(0)).count() == 0
    assert hard_negatives.mine(frame.withColumn("label", F.lit(1))).count() == 0


def test_products_are_exact_at_any_size():
    pick = np.random.default_rng(1)
    for scale in (1.0, 1e7, 1e9, 1e13, 1e25):
        q, p = (np.floor(pick.normal(size=(4, 6)) * scale) for _ in range(2))
        true = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in p] for a in q]
        assert [[int(x) for x in row] for row in exact.products(q, p)] == true
    with pytest.raises(OverflowError):
        exact.as_long([2**63])


@pytest.mark.parametrize("size,scale", [(2, 1), (8, 256), (64, 256), (300, 1e12)])
def test_bounds_hold_the_products(size, scale):
    pick = np.random.default_rng(size)
    x = np.concatenate((pick.normal(size=(120, size)), np.zeros((1, size)), np.eye(size)[:2], -np.eye(size)[:2]))
    x[60:90] = x[:30] * (1 + 1e-9 * pick.normal(size=(30, size)))  # nearly and exactly parallel and opposite ones
    x[90:120] = -2 * x[:30]
    x = np.floor(x * scale)
    angles = np.arccos(np.clip(hard_negatives.norms(x)[1] @ hard_negatives.references(x[:50].tolist(), size).T, -1, 1))
    norm = hard_negatives.norms(x)[0]
    low, high = hard_negatives.bounds(angles, angles, norm, norm, angles, angles, norm, norm, size)
    true = exact.products(x, x).astype(float)
    assert (low <= true).all() and (true <= high).all()
    ranges = [(angles[i : i + 25].min(0), angles[i : i + 25].max(0), norm[i : i + 25].min(), norm[i : i + 25].max()) for i in range(0, 125, 25)]
    lo, hi, least, most = (np.array(c) for c in zip(*ranges))
    low, high = hard_negatives.bounds(lo, hi, least, most, lo, hi, least, most, size)
    for i in range(5):
        for j in range(5):
            block = true[25 * i : 25 * i + 25, 25 * j : 25 * j + 25]
            assert low[i, j] <= block.min() and block.max() <= high[i, j]


def test_intervals_leave_out_most_rows_of_clustered_data():
    pick = np.random.default_rng(3)
    x = np.concatenate([c + 0.02 * pick.normal(size=(200, 6)) for c in pick.normal(size=(12, 6))])
    length, unit = hard_negatives.norms(x)
    angles = np.arccos(np.clip(unit @ hard_negatives.references(x[::20].tolist(), 6).T, -1, 1))
    low, high = hard_negatives.bounds(angles, angles, length, length, angles, angles, length, length, 6)
    true = x @ x.T
    kth = np.sort(true, axis=1)[:, -10]
    assert (high >= kth[:, None]).mean() < 0.25


def test_windows_round_inwards():
    for positive in (0, 1, 7, 99, 100, 101, 12345, -5):
        first, last = Rule().window(positive)
        assert [s for s in range(-30, 12000) if 30 * positive <= 100 * s <= 90 * positive] == list(range(first, last + 1))
