"""Text operators against brute force, on small tables with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash

from localexplain.llm import bpe, chat, kneser_ney, maxent, mixing, simhash, suffix_dedup, toxicity
from localexplain.llm.components import components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, copies and near copies, repeated rows."""
    pick = random.Random(5)
    vocabulary = ["the", "of", "Zeit", "año", "l'été", "x y", "日本", "😀", "a", "b", "Idiot"] + [f"w{i}" for i in range(200)]
    passages = [" ".join(pick.choice(vocabulary) for _ in range(30)) for _ in range(5)]
    out = []
    for i in range(150):
        parts = [pick.choice(passages)[pick.randrange(40) :] if pick.random() < 0.5 else " ".join(pick.choices(vocabulary, k=pick.randrange(25))) for _ in range(3)]
        out.append((i, pick.choice([" ", "\n", "\t "]).join(parts), pick.choice(["en", "de"]), pick.choice(["s1", "s2", "é", None])))
    out += [(200 + i, passages[0], "en", "s1") for i in range(12)]
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "en", "s2"), (303, "one", "en", "s2"), (304, "one two", None, "s2")]
    out += [(305, "word " * 30000, "en", "long"), (306, "a" * 50000, "en", "long")]
    out += [(None, passages[1], "en", "s1"), (None, passages[1], "en", "s1")]
    out += [(5, out[5][1], out[5][2], out[5][3]), (6, "another text of number six", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for name in ("size", "tag", "fp", "score", "copies", "n", "row", "word", "spans", "h", "toxic_score", "gone_id", "c0"):
        frame = frame.withColumn(name, F.lit(7))
    return frame.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_bpe_equals_tiktoken(docs, rows, none):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = bpe.tokenize(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = sorted((r[0] or -1, own.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)
    assert len(got) == len(expected)
    for r, (doc, ids, raw) in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.ids)), expected):
        assert (r.doc_id or -1, r.ids, r.n_tokens) == (doc, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert bpe.tokenize(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_text():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encoder, pick = bpe.Encoder(RANKS), random.Random(2)
    chunks, pieces = re.compile(bpe.CHUNK).findall, regex.compile(public_tokenizers.PATTERN).findall
    alphabets = ["ab", "aaabbbccc", "abcdefghijklmnop  \n", "éüß中文😀\x1c\x85　\xa0 \t\n", "01239 .,!?'sretvmld<|>"]
    for _ in range(3000):
        text = "".join(pick.choice(pick.choice(alphabets)) for _ in range(pick.randrange(60)))
        ids = encoder.encode_text(text, chunks, pieces)
        assert ids == own.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()
        assert "".join(chunks(text)) == text


def test_near_duplicates_equal_brute_force(docs, rows, none):
    def fingerprint(text):
        w = words(text)
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {r: fingerprint(r[1]) for r in set(rows)}
    keys = sorted(set(prints.values()))
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for r, f in prints.items():
        if r[0] is not None:
            least[root(f)] = min(r[0], least.get(root(f), r[0]))
    expected = Counter((r[0], f"{prints[r]:016x}", least.get(root(prints[r]))) for r in rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_ball_links_connect_all_pairs(spark):
    pick = random.Random(3)
    prints = {pick.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(3):
            p ^= 1 << pick.randrange(64)
            p ^= 1 << pick.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = dict(map(tuple, components(links).collect()))
    parent = {p: p for p in signed}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert all(found.get(p, p) == root(p) for p in signed)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 199)] + [(500, 400), (400, 450), (7, 7)] + [(1000, k) for k in range(1001, 1100)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(1, 200)}, 450: 400, 500: 400, **{k: 1000 for k in range(1001, 1100)}}


def removed(rows, length=50):
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            if doc is not None and doc < first.get(raw[i : i + length], math.inf):
                first[raw[i : i + length]] = doc
    for doc, text, *rest in rows:
        raw = (text or "").encode()
        gone, until = bytearray(len(raw)), 0
        for i in range(len(raw) - length + 1):
            if doc is not None and first[raw[i : i + length]] < doc:
                gone[max(i, until) : i + length] = b"\x01" * (i + length - max(i, until))
                until = i + length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        yield doc, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g), (doc, text, *rest)


def test_suffix_dedup_equals_brute_force(docs, rows, none):
    got = Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == Counter(r[:5] for r in removed(rows))
    assert suffix_dedup.remove_repeats(none).count() == 0
    cut = Counter((r.doc_id, r.text, r.source, r.n_chars, r.tag) for r in suffix_dedup.cut_texts(docs).collect())
    texts = [(r[0], None if r[5][1] is None else r[4].decode("utf-8", "ignore"), r[5][3]) for r in removed(rows)]
    assert cut == Counter((d, t, s, None if t is None else len(t), 7) for d, t, s in texts)


def test_large_groups_are_not_held(docs, rows):
    got = Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in suffix_dedup.remove_repeats(docs, group_bytes=300).collect())
    assert got == Counter(r[:5] for r in removed(rows))


def test_suffix_order_is_right_even_when_hashes_collide():
    pick = np.random.default_rng(4)
    buffer = pick.integers(97, 99, 3000).astype(np.uint8)
    starts = np.sort(pick.choice(2950, 900, replace=False))
    text = buffer.tobytes()
    expected = sorted(text[i : i + 50] for i in starts.tolist())
    # Base 1 makes all anagrams equal, so only the check against the bytes and the last resort can be right.
    for bases in (suffix_dedup.BASES, (1, suffix_dedup.BASES[1]), (1, 1, 1)):
        order, new = suffix_dedup.classes(buffer, starts, 50, bases)
        found = [text[starts[i] : starts[i] + 50] for i in order]
        assert found == expected
        assert new.tolist() == [True] + [a != b for a, b in zip(found, found[1:])]


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_ones, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_ones:  # share by weight, stop at the cap, share the excess again
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_ones:
            goal[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(goal[s] for s in full)
        open_ones -= full or open_ones
    assert len(got) == len(rows)
    longest = max(len(WORD.findall(r[1] or "")) for r in rows)
    for s in names:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(goal[s])
        biggest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - goal[s]) <= 2 * biggest
    assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] and r.copies >= 0 for r in got) and longest == 30000
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = Counter((r[0], r[1], r[3]) for r in mixing.mixed(docs).select("doc_id", "text", "lang", "source").collect())
    assert sum(copies.values()) == sum(r.copies for r in got)
    assert set(copies) <= {(r[0], r[1], r[2 + 1]) for r in rows}
    assert mixing.mix(none).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_toxicity(spark, docs, none):
    pick = random.Random(8)
    calm = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        t = pick.choices(calm, k=pick.randrange(5, 60))
        if toxic:
            t.insert(pick.randrange(len(t)), pick.choice(["Idiot,", "scum", "(moron)"]))
        texts.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    extra = [(0, 1, None), (None, 1, 1), (3, 0, 9)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks)
    again = toxicity.train(table.repartition(7), marks.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(model, again))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and len({r.score for r in odd if r.doc_id in (300, 301, 302)}) == 1
    assert toxicity.score(none, model).count() == 0
    untaught = toxicity.train(table, marks.limit(0))
    assert len(untaught[0]) == 0 and {r.score for r in toxicity.score(table, untaught).collect()} == {0.5}
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.filter("size = 7 and c0 = 7").count() == sum(r.score < 0.5 for r in odd)


def test_toxicity_learns_rare_words_from_large_samples(spark):
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5][:12_000]
    rare = set(ids[100:9700:1920])  # five texts: under the former floor of 12 000 * 0.0005 = 6
    table = spark.createDataFrame([(i, f"w{i % 7} w{i % 11}" + " scum" * (i in rare)) for i in ids], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i in rare)) for i in ids], "doc_id long, quality int, toxic int")
    hashes = toxicity.WordHashes()
    keys, _, _ = toxicity.train(table, marks, s=toxicity.Settings(l1=0.01, passes=2))
    assert toxicity.features(b"scum", hashes)[0] in keys


def test_language_model(spark, docs, rows, none):
    settings = maxent.Settings(classes=6, members=8, pair_rows=64, member_rows=64, head_words=100, tokens_per_task=1000)
    model = maxent.fit(docs, s=settings)
    got = maxent.score(docs, model).collect()
    train = Counter()
    for r in rows:
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2:
            train.update([*words(r[1]), None])
    total, distinct = sum(train.values()), len(train)
    assert (model.tokens, model.distinct) == (total, distinct) and len(got) == len(rows)

    def base(text):
        return sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in [*words(text), None])

    key = lambda doc, n, b: (doc is None, doc or 0, n, round(b, 6))
    expected = Counter(key(r[0], len(words(r[1])) + 1, base(r[1])) + (sum(train[w] > 0 for w in [*words(r[1]), None]),) for r in rows)
    assert Counter(key(r.doc_id, r.n_tokens, r.base_score) + (r.n_known,) for r in got) == expected
    assert all(r.train_tokens == total and math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert maxent.score(none, model).count() == 0
    assert maxent.score(none, maxent.fit(none)).count() == 0


def test_language_model_adds_up_to_one():
    s = maxent.Settings(classes=5, members=4, pair_rows=32, member_rows=32)
    pick = np.random.default_rng(1)
    head = [(f"w{i}".encode(), 50 - i) for i in range(30)]
    net = maxent.Net(s, maxent.first_weights(s, head, 2000))
    for _ in range(30):
        ids = pick.integers(0, s.words + 1, 200)
        first = np.zeros(200, bool)
        first[::20] = True
        net.step(ids, first)
    for history in ([], [3], [s.words, 2], [1, s.words, 7]):
        p = 0.0
        for w in range(s.words + 1):
            ids = np.array([*history, w])
            first = np.zeros(len(ids), bool)
            first[0] = True
            p += math.exp(net.log_probs(ids, first)[-1])
        assert p == pytest.approx(1, abs=1e-5)


def test_language_model_grows_with_its_words():
    s = maxent.Settings()
    assert s.words >= 47 * 96 and s.member_rows >= 16384
    small, large = s.grown(10_000), s.grown(1_000_000)
    assert small == s and large.words >= 1_000_000 // maxent.KNOWN_SHARE > s.words and large.parts > 1
    assert large.member_rows > s.member_rows and large.pair_rows > s.pair_rows
    # A class that is factored once more adds up to one as well, and learns.
    s = maxent.Settings(classes=4, members=5, pair_rows=32, member_rows=32).grown(maxent.KNOWN_SHARE * 58)
    assert s.parts > 1 and s.words >= 58
    pick = np.random.default_rng(1)
    net = maxent.Net(s, maxent.first_weights(s, [(f"w{i}".encode(), 90 - i) for i in range(s.words)], 4000))
    ids = pick.integers(0, 2, 400).cumsum() % (s.words + 1)
    first = np.arange(400) % 20 == 0
    before = net.log_probs(ids, first).sum()
    for _ in range(30):
        net.step(ids, first)
    assert net.log_probs(ids, first).sum() > before
    for history in ([], [3], [s.words, 2]):
        p = 0.0
        for w in range(s.words + 1):
            own = np.array([*history, w])
            p += math.exp(net.log_probs(own, np.arange(len(own)) == 0)[-1])
        assert p == pytest.approx(1, abs=1e-5)


def test_quality_model_equals_plain_kneser_ney(spark):
    pick = random.Random(6)
    texts = [" ".join(pick.choices("a b c d e f".split(), weights=[9, 5, 3, 2, 1, 1], k=pick.randrange(12))) for _ in range(60)]
    model = kneser_ney.train(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    c3 = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        c3.update(zip(w, w[1:], w[2:]))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter((c,) for _, c in c2)

    def off(counts):
        d = kneser_ney.discounts(Counter(n for n in counts.values() if n <= 4))
        return lambda n: 0.0 if not n else d[min(n, 3) - 1]

    def p(gram):
        counts = {3: c3, 2: c2, 1: c1}[len(gram)]
        d = off(counts)
        same = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:]) if len(gram) > 1 else 1 / (len(c1) + 1)
        if not same:
            return lower
        total = sum(same.values())
        return max(counts.get(gram, 0) - d(counts.get(gram, 0)), 0) / total + sum(map(d, same.values())) / total * lower

    shards = tuple([kneser_ney.Shard(*t) for t in part] for part in (model.adds, model.backs))
    for t in ["", "a", "a b c", "f f f q a", *texts[:10]]:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        keys = kneser_ney.grams(t.encode(), kneser_ney.WordKeys())
        found = kneser_ney.log_probs(shards, model.unknown, keys)
        assert found == pytest.approx([math.log10(p(tuple(w[i : i + 3]))) for i in range(len(w) - 2)], rel=1e-4)
    assert sum(p(("a", "b", w)) for w in [*"abcdef", "</s>"]) + p(("a", "b", "?")) == pytest.approx(1)


def test_quality_classifier(spark, docs, none):
    pick = random.Random(9)
    good = [" ".join(pick.choices([f"w{i}" for i in range(60)], weights=range(60, 0, -1), k=40)) for _ in range(400)]
    junk = ["".join(pick.choices("abcdefgh", k=200)).replace("a", " ") for _ in range(40)]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 440, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in kneser_ney.classify(table, labels).collect()}
    assert len(got) == 440 and np.mean([got[i] for i in range(400)]) > 0.97 and not any(got[i] for i in range(400, 440))
    odd = kneser_ney.classify(docs, labels).collect()
    assert len(odd) == docs.count()
    assert all(r.keep and r.threshold is None for r in kneser_ney.classify(docs, labels.limit(0)).collect())
    assert kneser_ney.classify(none, labels).count() == 0


def test_quality_sample_goes_on_after_long_texts(spark):
    rows = [(i, "long " * 100 if i % 4 == 0 else "short", "en") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = kneser_ney.trusted_ids(table.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    expected = {r.doc_id for r in trusted.filter("not held").collect() if r.doc_id % 4}
    assert {r.doc_id for r in kneser_ney.fitted_rows(table, trusted, words=60).collect()} == expected


def test_quality_limits_of_rare_languages(spark):
    pick = random.Random(10)
    rows = [(i, " ".join(pick.choices([f"w{k}" for k in range(50)], k=15)), "en") for i in range(6000)]
    rows += [(6000 + i, " ".join(pick.choices([f"x{k}" for k in range(3000)], k=15)), "xx") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = table.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = kneser_ney.classify(table, labels).collect()
    limits = {r.lang: r.threshold for r in got}
    assert len(got) == 6090 and limits["xx"] > 2 * limits["en"]
    assert np.mean([r.keep for r in got if r.lang == "xx"]) > 0.9


def test_chat_round_trip_and_machine(spark):
    tricky = ["<|im_end|>", "<\\|x", "<\\\\|", "<", "|>", "a<", "\\|", "", None, "<|im_start|>assistant\nhi", "zwei\nZeilen<|nl|>", "日本😀"]
    pick = random.Random(7)
    turns = []
    for conv in range(40):
        for turn in range(pick.randrange(1, 9)):
            turns.append((conv, turn, pick.choice(["user", "assistant", "system", None, "od\nd<|nl|>", "<|x"]), pick.choice(tricky)))
    turns += [(50, t, r, f"{r} {t}") for t, r in enumerate(["system", "user", "assistant", "tool", "assistant", "user"])]
    turns += [(51, 0, "user", "a"), (51, 0, "user", "a"), (51, None, "user", "first"), (None, 1, "assistant", "x" * 100000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    for name in ("row", "rows", "segments", "formatted"):
        frame = frame.withColumn(name, F.lit(1))
    chats = chat.format_chat(frame)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    whole = {r.conv_id: r for r in chats.collect()}
    groups = {}
    for c, t, r, x in turns:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g = [(r, x) for _, _, r, x in sorted(g)]
        assert got[c].n_turns == len(g)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in g).encode()).hexdigest()
        trained = "".join(x for r, x in g if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
        assert got[c].formatted_chars == len(whole[c].formatted)
        assert "".join(s.text for s in whole[c].segments) == whole[c].formatted
        state, bad = "", -1
        for i, (r, _) in enumerate(g):
            if bad < 0 and r not in chat.CHATML.follows.get(state, ()):
                bad = i
            state = r
        assert whole[c].first_bad_turn == bad
    assert whole[50].first_bad_turn == -1 and whole[51].first_bad_turn == 1
    assert chat.format_chat(frame.limit(0)).count() == 0
    plan = chat.digests(chats)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_runs_the_machine_without_python(spark, sf):
    from localexplain.llm import queries

    found = queries.op9_chat(spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|ExistingRDD|LogicalRDD|MapPartitions", plan)
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert "assistant\ntool" in optimized or "assistant\\ntool" in optimized  # the machine's edges
    rows = {r.conv_id: r for r in found.collect()}
    assert rows[-1].first_bad_turn == -1 and rows[-1].n_turns == 2
