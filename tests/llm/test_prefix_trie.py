"""The trie against building it from rebuilt conversations in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from localexplain.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def turn_key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    said = f"{len(role.encode())} {role}{text}"
    return turn is not None, turn or 0, hashlib.sha256(said.encode()).digest()


def rebuilt(rows):
    convs = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    out = {}
    for c, turns in convs.items():
        family = int(c / 20) * 20  # towards zero, as SQL's remainder does
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(convs.get(family, [])[:h] + turns[h:])
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs_of in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in under)]
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in under if m)
        ends = ",".join(str(c) for c in sorted(c for c in convs_of if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs_of), len(node), parent, len(convs_of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(4)
    said = [("user", "hello there"), ("assistant", "hi"), ("user", "a b c"), ("assistant", "ok ok"), (None, None), ("", ""), ("u", "ser x")]
    out = []
    for c in [*range(-45, 130), 500, 505, 519, 10**12, 10**12 + 3, 4096 * 5]:
        if pick.random() < 0.85 or c % 20 == 0 and c != 60:
            out += [(c, t, *pick.choice(said[: pick.choice([2, 7])])) for t in range(pick.choice([1, 1, 2, 3, 6]))]
    common = [(0, "user", "the same start of many words"), (1, "assistant", "and the same answer"), (2, "user", "thanks"), (3, "assistant", "bye"), (4, "user", "x")]
    for c in range(2000, 2600):  # a third and more of all conversations are one
        out += [(c, *turn) for turn in common]
    out += [(130, t, "user", f"w{t} " * 3) for t in range(300)]
    out += [(131, None, "user", "null first"), (131, 0, "user", "later"), (131, None, "user", "null first"), (131, 0, "user", "Later")]
    out += [(None, 0, "user", "nobody's"), (7, 0, "user", "long " * 50000)]
    return out


@pytest.fixture(scope="module")
def turns(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    for name in ("node", "parent", "depth", "place", "hash", "words", "taken", "n", "weight"):
        frame = frame.withColumn(name, F.lit(7))
    return frame


def test_equals_plain_python(turns, rows):
    got = sorted((tuple(r) for r in prefix_trie.digests(turns).collect()), key=str)
    expected = plain(rows)
    assert len(got) == len(expected)
    assert got == expected
    assert any(d == 0 and p is None for _, d, p, *_ in got) and any(n > 500 for _, _, _, n, *_ in got)


def test_turnless_conversations_end_at_the_root(spark):
    # Conversation 21 takes three turns of conversation 20, which has none, and has only two of its own.
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    frame = spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    ends = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.digests(frame).collect()] == [(c, 0, None, 1, 0, 1, 0, ends)]


def test_empty_table(turns):
    assert prefix_trie.digests(turns.limit(0)).count() == 0


def test_ends_of_a_large_group_come_in_order(spark):
    nodes = spark.range(-20000, 20000).select(F.lit(b"n").alias("node"), F.col("id").alias("conv_id")).repartition(5)
    expected = hashlib.sha256(",".join(map(str, range(-20000, 20000))).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.end_hashes(nodes).collect()] == [(b"n", expected)]


def test_texts_are_not_shuffled(turns):
    rows = prefix_trie.rebuilt(prefix_trie.turn_rows(turns))
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows.columns == ["conv_id", "place", "turn", "hash", "words", "taken"]
