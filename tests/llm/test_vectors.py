"""Vector searches against brute force."""

import math

import numpy as np
import pytest

from localexplain.llm import cover_tree, graph_ann


@pytest.fixture(scope="module")
def table(spark):
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(6, 8))
    x = (centres[pick.integers(0, 6, 900)] + 0.3 * pick.normal(size=(900, 8))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[50][1], 0) for i in range(120)]  # copies of one vector
    rows += [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [float("nan")] + [1.0] * 7, 0), (2150, [None] + [1.0] * 7, 0)]
    rows += [(2200, [float("inf")] * 8, 0), (None, rows[3][1], 0), (100, rows[100][1], 0), (3000, [1.0, 2.0], 0), (3100, [2.0, 2.0], 0), (3200, [], 0)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, table):
    made = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(6)
    return made.selectExpr("*", "1 AS v", "2 AS ids", "3 AS score", "4 AS shard", "5 AS size")


def plain(table, every, k, score, zero):
    usable = {(i, tuple(v)) for i, v, _ in table if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    if not zero:
        usable = {(i, v) for i, v in usable if any(v)}
    out = {}
    for q, a in sorted(usable):
        if q % every == 0:
            near = sorted((score(np.array(a), np.array(b)), i) for i, b in usable if i != q and len(a) == len(b))
            if near:
                out[q] = near[:k]
    return out


def test_graph_finds_huge_vectors(spark):
    pick = np.random.default_rng(5)
    x = pick.normal(size=(300, 4))
    x[100] *= 1e25
    x[101:106] = x[100] * (1 + 0.01 * pick.normal(size=(5, 4)))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = by_query(graph_ann.nearest(made, 100, 5).collect())
    expected = plain(rows, 100, 5, lambda a, b: math.sqrt(((a - b) ** 2).sum()), False)
    # A huge query has all its huge neighbours, and ordinary ones still have theirs.
    assert {i for _, i in got[100]} == {101, 102, 103, 104, 105}
    assert len({i for _, i in got[0] + got[200]} & {i for _, i in expected[0] + expected[200]}) >= 8


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["score"], r.vec_id))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 100])
def test_cover_tree_is_exact(frame, table, shard_rows):
    got = by_query(cover_tree.top_k(frame, shard_rows=shard_rows).collect())
    expected = plain(table, 50, 5, lambda a, b: -int(np.floor(256 * a) @ np.floor(256 * b)), True)
    assert got == {q: [(-s, i) for s, i in near] for q, near in expected.items()}


def test_cover_tree_prunes_and_stays_exact():
    pick = np.random.default_rng(3)
    points = np.floor(256 * (pick.normal(size=(40, 3))[pick.integers(0, 40, 5000)] + 0.01 * pick.normal(size=(5000, 3))))
    queries = points[:200]
    at, scores, work = cover_tree.dual_top_k(queries, cover_tree.CoverTree(points), 6)
    products = queries @ points.T
    order = np.argsort(-products, axis=1, kind="stable")[:, :6]
    assert np.array_equal(at, order) and np.array_equal(scores, np.take_along_axis(products, order, 1))
    assert work["products"] < 0.5 * work["pairs"]
    tree = cover_tree.CoverTree(points)
    stack = [tree.root]
    while stack:
        node = stack.pop()
        far = np.sqrt(((tree.sorted[node.lo : node.hi] - node.centre) ** 2).sum(1))
        assert far.max() <= node.radius * (1 + 1e-9) and sum(c.hi - c.lo for c in node.children) in (0, node.hi - node.lo)
        stack += node.children


def test_graph_search(frame, table):
    got = by_query(graph_ann.nearest(frame).collect())
    expected = plain(table, 100, 10, lambda a, b: math.sqrt(((a - b) ** 2).sum()), False)
    assert set(got) == set(expected)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in expected.items())
    assert hit >= 0.9 * sum(map(len, expected.values()))
    vectors = {}
    for i, v, _ in table:
        if i is not None and v:
            vectors.setdefault(i, []).append(np.array([x if x is not None else np.nan for x in v], float))
    for q, near in got.items():
        assert near == sorted(near) and all(i != q for _, i in near)
        for s, i in near:
            assert any(len(a) == len(b) and s == pytest.approx(math.sqrt(((a - b) ** 2).sum()), abs=1e-12) for a in vectors[q] for b in vectors[i])


def test_graph_of_a_large_shard_finds_nine_of_ten():
    pick = np.random.default_rng(4)
    x = pick.normal(size=(3000, 24))
    graph = graph_ann.Graph(x)
    near, _ = graph.walk(graph.seen_from_centre(x[:100]), graph_ann.QUERY_BEAM)
    exact = np.argsort(((x[:100, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a[:20]) & set(b)) / 10 for a, b in zip(near.tolist(), exact.tolist())]) >= 0.9
    assert (graph.edges >= 0).sum(1).max() <= graph.width


@pytest.mark.parametrize("mean,spread", [(0, 1), (1e3, 1), (1e4, 1), (1e8, 1), (-3e200, 1e190), (0, 1e-200)])
def test_graph_off_the_origin(mean, spread):
    pick = np.random.default_rng(6)
    x = mean + spread * pick.normal(size=(2000, 64))
    graph = graph_ann.Graph(x)
    near, _ = graph.walk(graph.seen_from_centre(x[:60]), graph_ann.QUERY_BEAM)
    exact = [np.argsort(graph_ann.distances(x, q), kind="stable")[:11] for q in x[:60]]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 11 for a, b in zip(near, exact)]) >= 0.9


def test_search_off_the_origin_and_of_mixed_magnitudes(spark):
    pick = np.random.default_rng(7)
    x = pick.normal(size=(1500, 16))
    x[:500] += 1e4
    x[500:1000] = x[500:1000] * 1e20 + 1e22
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = by_query(graph_ann.nearest(made, 50, 10, shard_rows=400).collect())
    expected = plain(rows, 50, 10, lambda a, b: float(graph_ann.distances(a[None], b)[0]), False)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in expected.items())
    assert set(got) == set(expected) and hit >= 0.9 * sum(map(len, expected.values()))


@pytest.mark.parametrize("scale", [1e5, 1e6, 1.2e6])
def test_cover_tree_beyond_doubles(spark, scale):
    pick = np.random.default_rng(9)
    x = scale + pick.normal(size=(150, 64))
    x[75:] = x[:75] + pick.integers(0, 2, (75, 64)) / 256  # near ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = by_query(cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=10).collect())
    whole = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    for q in range(0, 150, 10):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(150) if i != q)[:5]
        assert got[q] == [(-s, i) for s, i in best]
    assert got[0][0][0] > 2**53


def test_a_score_beyond_longs_is_an_error(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (50, [1.0, 1.0])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range of a long"):
        cover_tree.top_k(made).collect()


def test_an_index_is_prepared_once(spark, monkeypatch):
    """Index rows are not copied for blocks of queries."""
    made = spark.range(400).selectExpr("id AS vec_id", "array(double(id % 17), double(id % 23), 1D) AS embedding")
    got = by_query(cover_tree.top_k(made, every=1, shard_rows=50).collect())
    rows = [(r.vec_id, r.embedding, 0) for r in made.collect()]
    expected = plain(rows, 1, 5, lambda a, b: -int(np.floor(256 * a) @ np.floor(256 * b)), True)
    assert got == {q: [(-s, i) for s, i in near] for q, near in expected.items()}


def test_small_and_empty_tables(spark, frame):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert by_query(cover_tree.top_k(few).collect()) == {0: [(65536, 7), (0, 100)], 100: [(65536, 7), (0, 0)]}
    assert by_query(graph_ann.nearest(few).collect()) == {0: [(1.0, 7), (math.sqrt(2), 100)], 100: [(1.0, 7), (math.sqrt(2), 0)]}
    for search in (cover_tree.top_k, graph_ann.nearest):
        assert search(few.limit(0)).count() == 0
