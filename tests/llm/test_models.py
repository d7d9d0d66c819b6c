"""Trained models against the same arithmetic in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from localexplain.llm import kneser_ney, maxent, toxicity

SHAPES = [
    maxent.Settings(classes=5, members=3, pair_rows=7, member_rows=11),
    maxent.Settings(classes=4, parts=2, members=3, pair_rows=5, member_rows=9),
]


def random_net(s, seed):
    pick = np.random.default_rng(seed)
    return maxent.Net(s, [pick.normal(size=shape).astype(np.float32) for shape in s.shapes])


def stream(s, n, seed):
    pick = random.Random(seed)
    ids = [pick.randrange(s.words + 1) for _ in range(n)]
    return np.array(ids), np.array([i == 0 or pick.random() < 0.1 for i in range(n)])


def features(s, ids, first, i):
    """(tables, rows, answer) of each softmax of token i, written out."""
    start, span, m = s.words + 1, s.words + 2, 1 << 64
    one = start if first[i] else int(ids[i - 1])
    two = start if first[i] or first[i - 1] else int(ids[i - 2])
    word = int(ids[i])
    pair = ((one * 0x9E3779B1 % m + two * 0x85EBCA77 % m) % m) >> 7
    out = [([2, 1, 3], [two, one, pair % s.pair_rows], word // (s.parts * s.members) if word < s.words else s.classes - 1)]
    if word < s.words:
        for level, (nodes, width, under) in enumerate(s.inner):
            node = word // (width * under)

            def hashed(w, salt):
                return ((w * nodes + node) * salt % m >> 9) % s.member_rows

            out.append(([4 + 3 * level, 5 + 3 * level, 6 + 3 * level], [node, hashed(one, 0x9E3779B1), hashed(two, 0xC2B2AE35)], word // under % width))
    assert span == len(range(s.words + 2))
    return out


def softmax(net, tables, rows):
    width = net.weights[tables[0]].shape[1]
    logits = [sum(float(net.weights[t][r][k]) for t, r in zip(tables, rows)) for k in range(width)]
    if tables[0] == 2:
        logits = [x + float(b) for x, b in zip(logits, net.weights[0][0])]
    top = max(logits)
    powers = [math.exp(x - top) for x in logits]
    return [p / sum(powers) for p in powers]


@pytest.mark.parametrize("s", SHAPES)
def test_scores_equal_a_softmax_in_plain_python(s):
    net = random_net(s, 1)
    ids, first = stream(s, 60, 2)
    got = net.log_probs(ids, first)
    for i in range(len(ids)):
        want = sum(math.log(softmax(net, t, r)[a]) for t, r, a in features(s, ids, first, i))
        assert got[i] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("s", SHAPES)
def test_a_gradient_step_equals_plain_python(s):
    net, plain = random_net(s, 3), random_net(s, 3)
    ids, first = stream(s, 80, 4)
    slopes = [{} for _ in s.shapes]  # table -> row -> gradient
    for i in range(len(ids)):
        for tables, rows, answer in features(s, ids, first, i):
            p = softmax(plain, tables, rows)
            slope = np.array([x - (k == answer) for k, x in enumerate(p)])
            for t, r in [*zip(tables, rows), *([(0, 0)] if tables[0] == 2 else [])]:
                slopes[t][r] = slopes[t].get(r, 0) + slope
    net.step(ids, first)
    for t, rows in enumerate(slopes):
        want = plain.weights[t].astype(float)
        for r, slope in rows.items():
            want[r] -= s.rate / math.sqrt(1e-3 + float((slope**2).mean())) * slope
        assert np.allclose(net.weights[t], want, atol=2e-4), t


def test_run_sums():
    pick = np.random.default_rng(5)
    part = pick.normal(size=(500, 4))
    starts = np.unique(np.concatenate(([0, 3, 4, 5, 300], pick.integers(0, 200, 30))))
    want = np.add.reduceat(part, starts, axis=0)
    assert np.allclose(maxent.run_sums(part, starts), want) and np.allclose(maxent.run_sums(part[:1], np.array([0])), part[:1])


def plain_ftrl(texts, labels, z, n, s):
    """One pass over lists of positions, number by number; the last position is the bias."""
    last = len(z) - 1
    for at, label in zip(texts, labels):
        weights = {}
        for i in [*at, last]:
            l1 = 0.0 if i == last else s.l1
            small = abs(z[i]) <= l1 and i != last
            weights[i] = 0.0 if small else (math.copysign(l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
        x = max(-35.0, min(35.0, sum(weights.values())))
        g = 1 / (1 + math.exp(-x)) - label
        for i, w in weights.items():
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g


def test_toxicity_weights_equal_plain_ftrl(spark):
    pick = random.Random(6)
    rows = []
    for i in range(160):
        toxic = i % 3 == 0
        words = pick.choices([f"w{k}" for k in range(30)], k=12) + (["scum"] if toxic else [])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    s = toxicity.Settings(l1=0.3)
    keys, weights, bias = toxicity.train(docs, labels, s=s)

    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    shard_of = {r.d: r.h for r in spark.createDataFrame([(str(r[0]),) for r in learnt], "d string").selectExpr("d", f"int(pmod(xxhash64(d), {s.shards})) AS h").collect()}
    found = {r[0]: np.unique(toxicity.features(r[1].encode(), toxicity.WordHashes())) for r in learnt}
    texts_with = Counter(f for fs in found.values() for f in fs.tolist())
    dictionary = sorted(f for f, c in texts_with.items() if c >= s.min_texts)
    place = {f: i for i, f in enumerate(dictionary)}
    shards = {}
    for i, _, t in sorted(learnt, key=lambda r: str(r[0])):
        shards.setdefault(shard_of[str(i)], []).append(([place[f] for f in found[i].tolist() if f in place], t))
    z, n = [0.0] * (len(dictionary) + 1), [0.0] * (len(dictionary) + 1)
    for _ in range(s.passes):
        ends = []
        for _, some in sorted(shards.items()):
            own = [np.float32(z).astype(float).tolist(), np.float32(n).astype(float).tolist()]
            plain_ftrl([a for a, _ in some], [t for _, t in some], *own, s)
            ends.append(np.float32(own).astype(float))
        z, n = (np.mean([e[k] for e in ends], axis=0).tolist() for k in (0, 1))
    want = {}
    for f, i in place.items():
        if abs(z[i]) > s.l1:
            want[f] = (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    assert sorted(want) == keys.tolist() and len(want) > 20
    assert np.allclose([want[f] for f in keys.tolist()], weights, atol=1e-5)
    assert bias == pytest.approx(-z[-1] / ((s.beta + math.sqrt(n[-1])) / s.alpha + s.l2), abs=1e-5)


def test_quality_limits_are_quantiles_by_language(spark):
    pick = random.Random(8)
    rows, labels = [], []
    for i in range(420):
        lang = "rare" if i % 30 == 0 else ("en", "de", None)[i % 3]
        words = [f"{lang}{pick.randrange(40)}" for _ in range(pick.randrange(9, 40))]
        rows.append((i, " ".join(words if i % 7 else [f"junk{pick.randrange(10**6)}" for _ in words]), lang))
        if i % 7:
            labels.append((i, 1, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = {r.doc_id for r in kneser_ney.fitted_rows(docs, kneser_ney.trusted_ids(table)).select("doc_id").distinct().collect()}
    found = kneser_ney.classify(docs, table).collect()
    trusted = {r[0] for r in labels} & {r.doc_id for r in kneser_ney.trusted_ids(table).collect()}
    logs = {}
    for r in found:
        if r.doc_id in trusted - fitted and r.n_tokens > kneser_ney.LEAST_WORDS:
            logs.setdefault(r.lang, []).append(math.log10(r.perplexity))

    def level(values):  # the smallest value that a share of `quantile` does not exceed
        return sorted(values)[max(0, math.ceil(kneser_ney.QUANTILE * len(values)) - 1)]

    everything = level([x for some in logs.values() for x in some])
    assert len(logs.get("rare", [])) < 20 <= len(logs["en"])
    for r in found:
        some = logs.get(r.lang, [])
        limit = (level(some) if len(some) >= 20 else everything) + kneser_ney.SLACK
        assert math.log10(r.threshold) == pytest.approx(limit, abs=1e-9)
        assert r.keep == (r.n_tokens <= kneser_ney.LEAST_WORDS or math.log10(r.perplexity) <= limit + 1e-12)
    assert sum(not r.keep for r in found) > 10


def test_quality_counts_come_from_all_trusted_rows(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(f"w{pick.randrange(300)}" for _ in range(pick.randrange(0, 14))) if i % 97 else None, "en") for i in range(5400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    trusted = kneser_ney.trusted_ids(docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    kept = {r.doc_id for r in trusted.filter("NOT held").collect()}
    chosen = kneser_ney.fitted_rows(docs, trusted)
    assert {r.doc_id for r in chosen.collect()} == kept and len(kept) > 3000

    # Tables in shards, asked by blocks, say what one model on the driver says.
    texts = chosen.select(F.col("text").cast("binary").alias("text"))
    model, (orders, unknown) = kneser_ney.train(texts), kneser_ney.weights(texts)
    shards = tuple([kneser_ney.Shard(*t) for t in part] for part in (model.adds, model.backs))
    odd = docs.unionByName(spark.createDataFrame([(1, "nobody said this", None), (None, "", "de"), (None, "", "de")], docs.schema))
    got = kneser_ney.perplexities(odd, orders, unknown, block_bytes=4000, shard_keys=1000).collect()
    plain = {t: kneser_ney.log_probs(shards, model.unknown, kneser_ney.grams(t.encode(), kneser_ney.WordKeys())) for t in {t or "" for _, t, _ in rows} | {"nobody said this"}}
    text_of = {i: t or "" for i, t, _ in rows} | {None: ""}
    for r in got:
        logs = plain["nobody said this" if r.doc_id == 1 and r.lang is None else text_of[r.doc_id]]
        assert r.n_tokens == len(logs) and r.mean_log == pytest.approx(-logs.mean(), abs=1e-9)
    assert len(got) == 5403
