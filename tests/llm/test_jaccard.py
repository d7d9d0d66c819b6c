"""Near-duplicates by five-word shingles against brute force, and what boilerplate costs."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from localexplain.llm import jaccard
from localexplain.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset([()])


def expected(rows):
    sets = list({shingles(t) for _, t in rows})
    root = {s: s for s in sets}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in sets:
        for b in sets:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[top(a)] = top(b)
    ids = {}
    for d, t in rows:
        ids.setdefault(top(shingles(t)), []).append(d)
    smallest = {r: min((d for d in some if d is not None), default=None) for r, some in ids.items()}
    return Counter((d, smallest[top(shingles(t))]) for d, t in rows), len(ids)


def edited(words, n, pick):
    words = list(words)
    for _ in range(n):
        words[pick.randrange(len(words))] = f"edit{pick.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(1)
    out = []
    for i in range(60):
        words = [f"w{pick.randrange(2000)}" for _ in range(pick.randrange(5, 150))]
        out += [(100 * i + k, " ".join(edited(words, k, pick))) for k in range(pick.choice([1, 1, 6]))]
    common = [f"c{i}" for i in range(300)]
    # A band of many nodes: around boilerplate, some of them near copies of each other.
    for i in range(90):
        own = [f"o{i}x{k}" for k in range(70)]
        out.append((10000 + i, " ".join(common + own)))
        if i % 10 == 0:
            out.append((20000 + i, " ".join(common + edited(own, 3, pick))))
    chain = [f"z{i}" for i in range(400)]
    for i in range(100):  # each is near its neighbours only
        out.append((30000 + i, " ".join(chain[i : i + 250])))
    out += [(1, None), (2, ""), (3, "  "), (None, ""), (None, out[0][1]), (None, "only nobody says this at all"), (0, out[5][1]), (40000, "one two")]
    out += [(40001, "long " * 50000 + "end"), (50000 + 1, out[0][1]), (50001, out[0][1]), (50001, "TWO words ONE")]
    return out


@pytest.mark.parametrize("all_pairs", [64, 4])
def test_equals_brute_force(spark, rows, all_pairs, monkeypatch):
    monkeypatch.setattr(jaccard, "ALL_PAIRS", all_pairs)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for name in ("node", "size", "band", "k1", "first", "key", "text is null"):
        frame = frame.withColumn(name, F.lit(7))
    found = jaccard.near_duplicates(frame).collect()
    components, groups = expected(rows)
    assert Counter((r.doc_id, r.component_id) for r in found) == components
    assert len({(r.doc_id, r.k1, r.k2) for r in found if r.first}) == groups


def test_boilerplate_grows_in_proportion(spark, monkeypatch):
    common = [f"c{i}" for i in range(300)]
    met = []
    for n in (100, 200, 400):
        texts = [(i, " ".join(common + [f"o{i}x{k}" for k in range(70)])) for i in range(n)]
        count = []
        alike = jaccard.alike
        with monkeypatch.context() as m:
            m.setattr(jaccard, "alike", lambda pairs, *rest, count=count, alike=alike: (count.append(pairs.count()), alike(pairs, *rest))[1])
            found = jaccard.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
        assert len({r.component_id for r in found}) == n
        met.append(sum(count))
    assert met[2] < 5 * met[0] and met[2] < 400 * jaccard.BANDS


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    pick = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    texts = [(i, " ".join(edited(base, 1, pick))) for i in range(300)]
    count = []
    alike = jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda pairs, *rest: (count.append(pairs.count()), alike(pairs, *rest))[1])
    found = jaccard.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {r.component_id for r in found} == {0} and sum(r.first for r in found) == 1 and sum(count) < 300 * 10

def test_edited_copies_meet_around_the_least_edited(spark, monkeypatch):
    pick = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [(i, " ".join(edited(base, pick.randrange(25), pick))) for i in range(400)]
    count = []
    alike = jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda pairs, *rest: (count.append(pairs.count()), alike(pairs, *rest))[1])
    found = jaccard.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == expected(texts)[0]
    assert sum(count) < 400 * 25


def test_rarest_shingles_name_a_pair_once(spark):
    pick = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = [(i, " ".join(edited(base, pick.randrange(12), pick))) for i in range(60)]
    sets = {i: shingles(t) for i, t in texts}
    nodes = spark.createDataFrame([(i, i, len(s)) for i, s in sets.items()], "node long, root long, size long")
    rows = spark.createDataFrame([(i, t.encode()) for i, t in texts], "node long, text binary")
    pairs = jaccard.by_rarest(nodes, rows, (4, 5), 5, 42)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    met = Counter((r.u, r.v) for r in pairs.collect())
    similar = {(u, v): len(sets[u] & sets[v]) / len(sets[u] | sets[v]) for u in sets for v in range(u) if u in sets}
    assert set(met.values()) == {1} and "Aggregate" not in plan
    assert {p for p, s in similar.items() if s >= 0.8} <= set(met) and min(similar[p] for p in met) > 0.6


def test_simhash_finds_what_bands_would_not(spark, monkeypatch):
    pick = random.Random(7)
    words = [f"w{pick.randrange(10**6)}" for _ in range(4000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[5:] + words[:5])), (4, "something else altogether is said here")]
    monkeypatch.setattr(jaccard, "in_shared_bands", lambda places, several: places.join(several, "band").drop("n").filter("false"))
    found = jaccard.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 4}

def test_rows_of_bands_with_one_node_leave_no_join(spark):
    # a band with a large share of the rows, others with two nodes, most with one
    rows = [(i, 0) for i in range(500)] + [(i, 1 + i // 2) for i in range(100)] + [(i, -1 - i) for i in range(2000)]
    places = spark.createDataFrame(rows, "node long, band long")
    several = places.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("v")).filter("n > 1").withColumn("band_nodes", F.col("n"))
    found = jaccard.in_shared_bands(places, several)
    got = Counter((r.node, r.band, r.v, r.band_nodes) for r in found.collect())
    assert got == Counter([(i, 0, 0, 500) for i in range(500)] + [(i, 1 + i // 2, i // 2 * 2, 2) for i in range(100)])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in text and "LeftOuter" not in text and text.count("Inner") == text.count("SortMergeJoin") > 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.firsts(empty).columns == ["doc_id", "text"]


def test_rounds_of_components_drop_their_shuffles(spark):
    """What a round has written and read again is not held on, in the driver or on disk, until the driver happens to collect."""

    def held() -> int:
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    def falls_to(most: int) -> bool:
        for _ in range(50):
            if held() <= most:
                return True
            time.sleep(0.2)
        return False

    spark._jvm.System.gc()
    time.sleep(2)
    before = held()
    roots = components(spark.range(300).selectExpr("id + 1 AS u", "id AS v"), "chain")
    assert falls_to(before + 6), (before, held())  # a round makes as many, there are at least five rounds
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(1, 301)}
