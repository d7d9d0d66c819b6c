"""Host rules against counting in plain Python, and hosts of known quality."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from localexplain.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, doubled, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(covered), lines


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    vocabulary = ["the", "of", "año", "日本", "😀", "a#b", "x y", "<p>", "100%"] + [f"word{i}" for i in range(60)]
    out = []
    for i in range(400):
        host = pick.choice(["good.net"] * 3 + ["odd.net", None, "é"])
        text = pick.choice([" ", "\n", "\t ", "\r\n"]).join(pick.choices(vocabulary, k=pick.randrange(80)))
        if pick.random() < 0.3:
            text += "\n" + text[: len(text) // 2] + "\n" + text
        if host == "odd.net":
            text += " | # | # | # | #" * 3 + " " + " ".join(f"w{pick.random()}" for _ in range(60))
        out.append((i, text, host))
    out += [(500 + i, "one line of only a few", "spam.net") for i in range(50)]
    out += [(600 + i, " ".join(f"w{pick.random()}" for _ in range(30)), "spam.net") for i in range(10)]
    out += [(700, None, "good.net"), (701, "", "good.net"), (702, " \n\t", None), (703, "word " * 30000, "good.net"), (704, "b" * 50000, "good.net")]
    out += [(705, " ".join(f"n{i % 7000}" for i in range(30000)), "good.net"), (706, "failing only here", "lone.net")]
    out += [(None, out[5][1], "good.net"), (5, out[5][1], out[5][2]), (5, out[6][1], "good.net")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("host", "keep", "counts", "n", "verdict", "f_base", "n_words", "kept", "text is null"):
        frame = frame.withColumn(name, F.lit(7))
    return frame


def test_counts_equal_plain_python(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[n] for n in names), r.base_failed) for r in host_rules.verdicts(docs).collect())
    expected = []
    for doc_id, text, _ in rows:
        c = counts(text)
        expected.append((doc_id is None, doc_id or 0, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(expected)


def test_many_different_words_need_ranks():
    pick = random.Random(1)
    words = [f"w{pick.randrange(9000)}" for _ in range(12000)]
    words[7000:7300] = words[100:400]
    often = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    assert len(set(words)) ** 5 > 2**63
    assert host_rules.repeated_words(words) == len({i + j for i in range(len(words) - 4) if often[tuple(words[i : i + 5])] > 1 for j in range(5)})


def plain_verdicts(rows, limits):
    """Host verdicts from rates and a prior computed from scratch."""
    tally = defaultdict(lambda: [0, 0, 0, 0, 0])
    failed = []
    for _, text, host in rows:
        w, chars, symbols, doubled, repeated, lines = counts(text)
        f = [w < 10 or 100 * repeated > 20 * w, 10 * symbols > w, 10 * doubled > 3 * lines, chars < 3 * w or chars > 10 * w]
        failed.append((host, f))
        if host is not None:
            for i, x in enumerate([1, *f]):
                tally[host][i] += x
    n = sum(t[0] for t in tally.values())
    verdicts = {}
    for host in tally:
        verdicts[host] = [0, 0, 0, 0]
    for rule in range(4):
        total = sum(t[rule + 1] for t in tally.values())
        p = total / n
        between = sum(t[0] * (t[rule + 1] / t[0] - p) ** 2 for t in tally.values())
        room = n - sum(t[0] ** 2 for t in tally.values()) / n - (len(tally) - 1)
        share = (between / (p * (1 - p)) - (len(tally) - 1)) / room if 0 < p < 1 and room > 0 else 0
        strength = 1 / min(max(share, 1 / (n + 1)), 0.99) - 1
        for host, t in tally.items():
            verdicts[host][rule] = (t[rule + 1] + (total + 1) / (n + 2) * strength) / (t[0] + strength)
    kept = []
    for host, f in failed:
        rates = verdicts.get(host, [0, 0, 0, 0])
        soft = any(x and r > limits.doubtful for x, r in zip(f[1:], rates[1:]))
        kept.append(not f[0] and max(rates) <= limits.bad and not soft)
    return kept, verdicts


def test_verdicts_equal_plain_python(docs, rows):
    limits = host_rules.Limits()
    kept, rates = plain_verdicts(rows, limits)
    got = sorted((str(r.keep), r.kept) for r in host_rules.judge(docs).collect())
    assert got == sorted((str(doc_id), k) for (doc_id, _, _), k in zip(rows, kept))
    # Clean documents of the host that is mostly spam go; one failure doesn't condemn a host of one document.
    assert rates["spam.net"][0] > 0.5 and not any(k for (_, _, h), k in zip(rows, kept) if h == "spam.net")
    assert rates["lone.net"][0] < 1 and rates["odd.net"][1] > 0.2
    assert any(k for (_, _, h), k in zip(rows, kept) if h is None)


def test_keep_documents_gives_whole_rows(docs, rows):
    kept, _ = plain_verdicts(rows, host_rules.Limits())
    got = host_rules.keep_documents(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(t) for (_, t, _), k in zip(rows, kept) if k)


def test_prior_follows_the_spread_of_rates():
    alike = host_rules.beta_prior(10, 1000, 10 * 100.0**2, 100, 10 * 10.0**2 / 100)
    apart = host_rules.beta_prior(10, 1000, 10 * 100.0**2, 500, 5 * 100.0**2 / 100)
    assert sum(alike) > 500 and sum(apart) < 1 and alike[0] / sum(alike) == pytest.approx(101 / 1002)
    assert host_rules.beta_prior(0, 0, 0.0, 0, 0.0) == (1.0, 1.0)


def test_hosts_of_urls(spark):
    urls = ["http://www.Example.org/a?b", "https://u:p@m.x.net:8080/", "ftp://h", "no url", None, "http:///path", "https://a.b.?q"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in frame.select(host_rules.host_of(F.col("url"))).collect()]
    assert got == ["example.org", "m.x.net", "h", None, None, None, "a.b"]


def test_empty_table_and_no_hosts(spark, docs):
    assert host_rules.verdicts(docs.limit(0)).count() == 0
    without = docs.withColumn("source", F.lit(None).cast("string"))
    assert {r.kept == (not r.base_failed) for r in host_rules.verdicts(without).collect()} == {True}
