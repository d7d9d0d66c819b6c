"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The most frequent words are dealt to classes by frequency; all others share one class, in which a word's probability
comes from its count. P(word) = P(class | history) * P(word | class, history); where many words are known, a class is
factored once more, into parts and their members. Sizes grow with the different words. The history's features are the word
before, the word before that (a skip feature) and the pair of both, hashed to rows of weights. Training reads every
training text once: in each round tasks start from the broadcast weights, take gradient steps over their share of the
texts, and their changes are averaged block by block.

Counts of words cover the whole corpus. The head of the vocabulary is bounded and broadcast; words of the tail are
counted per text and joined with their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.llm.common import remainder, stored

END = b""  # the end of a text; no word is empty
FLUSH_WORDS = 1 << 18
TOKENS_PER_STEP = 1 << 14
TOKENS_PER_SCORE = 1 << 15
BLOCK_ROWS = 512
KNOWN_SHARE = 64  # at least every such part of the different training words is in a class of its own, up to the head


@dataclass(frozen=True)
class Settings:
    classes: int = 48  # the last one holds all words outside the head of classes * parts * members
    members: int = 96
    pair_rows: int = 1 << 14
    member_rows: int = 1 << 14
    head_words: int = 1 << 17  # words with a broadcast count
    rounds: int = 2
    tokens_per_task: int = 2_000_000  # at least so many on average: each task sends its changed weights once a round
    rate: float = 0.2
    parts: int = 1  # of a class

    @property
    def words(self) -> int:
        return (self.classes - 1) * self.parts * self.members

    def grown(self, distinct: int) -> Settings:
        """For so many different training words; never smaller. Tasks read more where they send more weights."""
        words = min(distinct // KNOWN_SHARE, self.head_words)
        if words <= self.words:
            return self
        more, each = words / self.words, words / (self.classes - 1)
        parts = math.ceil(math.sqrt(each))
        return replace(
            self,
            parts=parts,
            members=math.ceil(each / parts),
            pair_rows=int(self.pair_rows * math.sqrt(more)),
            member_rows=int(self.member_rows * math.sqrt(more)),
            tokens_per_task=int(self.tokens_per_task * more),
        )

    @property
    def inner(self) -> list[tuple[int, int, int]]:
        """(nodes, width, words under each answer) of the softmaxes below the classes."""
        last = (self.classes * self.parts, self.members, 1)
        return [last] if self.parts == 1 else [(self.classes, self.parts, self.members), last]

    @property
    def shapes(self) -> tuple[tuple[int, int], ...]:
        """Weights: class bias, class by word before, by skipped word, by pair; of each inner softmax bias and by hashed features."""
        c, w = self.classes, self.words + 2
        below = [shape for nodes, m, _ in self.inner for shape in ((nodes, m), (self.member_rows, m), (self.member_rows, m))]
        return ((1, c), (w, c), (w, c), (self.pair_rows, c), *below)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white space characters."""
    return (text or b"").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all rows of texts (text binary), ends included; counted per task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            seen[END] += batch.num_rows
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH_WORDS:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `most`, largest count first: all words whose count is above what would be too many."""
    levels = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for n, words in levels:
        total += words
        if total > most:
            break
        least = n
    if least is None:
        return []
    rows = counts.filter(F.col("n") >= least).collect()  # at most `most` rows
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda r: (-r[1], r[0]))


class Net:
    """The weights and their gradient steps, on streams of word numbers."""

    def __init__(self, s: Settings, weights: list[np.ndarray]):
        self.s, self.weights = s, weights
        self.squares = [np.full(len(w), 1e-3, np.float32) for w in weights]

    def history(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before and the one before that; words + 1 where the text begins. first marks first tokens of texts."""
        start = self.s.words + 1
        one = np.concatenate(([start], ids[:-1]))
        one[first] = start
        two = np.concatenate(([start], one[:-1]))
        two[first] = start
        return one, two

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> tuple[list, list[list], np.ndarray]:
        """What the softmaxes share. For classes and for each inner softmax: rows of each feature by different history (the
        skip feature's in order), the history of each token, and the answer; then which tokens have inner softmaxes.

        Many tokens have the same history, so everything but the answers is done once for each different one.
        """
        s, span = self.s, self.s.words + 2
        one, two = self.history(ids, first)
        inside = np.flatnonzero(ids < s.words)
        cls = np.full(len(ids), s.classes - 1)
        cls[inside] = ids[inside] // (s.parts * s.members)

        key, which = np.unique(two * span + one, return_inverse=True)
        k_one, k_two = key % span, key // span
        pair = (k_one.astype(np.uint64) * np.uint64(0x9E3779B1) + k_two.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)
        by_class = [[k_two, k_one, (pair % np.uint64(s.pair_rows)).astype(np.int64)], which, cls]

        below = []
        for nodes, width, under in s.inner:
            node = ids[inside] // (width * under)
            key, which = np.unique((node * span + two[inside]) * span + one[inside], return_inverse=True)
            k_node = key // (span * span)

            def hashed(word: np.ndarray, salt: int) -> np.ndarray:
                return (((word * nodes + k_node).astype(np.uint64) * np.uint64(salt) >> np.uint64(9)) % np.uint64(s.member_rows)).astype(np.int64)

            features = [k_node, hashed(key % span, 0x9E3779B1), hashed(key // span % span, 0xC2B2AE35)]
            below.append([features, which, ids[inside] // under % width])
        return by_class, below, inside

    def softmax(self, tables: list[int], rows: list[np.ndarray], bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each history times a factor, and that factor."""
        out = self.weights[tables[0]][rows[0]]
        for t, r in zip(tables[1:], rows[1:]):
            out += self.weights[t][r]
        if bias is not None:
            out += bias
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        return out, out.sum(1)

    def log_probs(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logarithms: of class and member, or of the class alone for a word outside the head."""
        (c_rows, c_of, cls), below, inside = self.contexts(ids, first)
        p, total = self.softmax([2, 1, 3], c_rows, self.weights[0])
        out = np.log(np.maximum(p[c_of, cls] / total[c_of], 1e-30)).astype(float)
        if len(inside):
            for i, (rows, of, answer) in enumerate(below):
                q, total = self.softmax([4 + 3 * i, 5 + 3 * i, 6 + 3 * i], rows)
                out[inside] += np.log(np.maximum(q[of, answer] / total[of], 1e-30))
        return out

    def step(self, ids: np.ndarray, first: np.ndarray) -> None:
        (c_rows, c_of, cls), below, inside = self.contexts(ids, first)
        p = self.gradient(*self.softmax([2, 1, 3], c_rows, self.weights[0]), c_of, cls)
        self.move(0, np.zeros(1, np.int64), p.sum(0, keepdims=True))
        self.descend([2, 1, 3], c_rows, p)
        if len(inside):
            for i, (rows, of, answer) in enumerate(below):
                tables = [4 + 3 * i, 5 + 3 * i, 6 + 3 * i]
                self.descend(tables, rows, self.gradient(*self.softmax(tables, rows), of, answer))

    def gradient(self, p: np.ndarray, total: np.ndarray, history: np.ndarray, answer: np.ndarray) -> np.ndarray:
        """Expected minus seen answers of each different history, in p's place."""
        p *= (np.bincount(history, minlength=len(p)) / total)[:, None].astype(np.float32)
        np.subtract.at(p.reshape(-1), history * p.shape[1] + answer, np.float32(1))
        return p

    def descend(self, tables: list[int], rows: list[np.ndarray], gradient: np.ndarray) -> None:
        """Adds up the gradient by row; the first feature's rows are in order already."""
        for i, (t, r) in enumerate(zip(tables, rows)):
            if i:
                order = np.argsort(r, kind="stable")
                r, part = r[order], gradient[order]
            else:
                part = gradient
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            self.move(t, r[starts], run_sums(part, starts))

    def move(self, table: int, rows: np.ndarray, total: np.ndarray) -> None:
        """Each row at its own rate, which falls with the squares of its gradients."""
        squares = self.squares[table][rows] + np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1])
        self.squares[table][rows] = squares
        total *= (self.s.rate / np.sqrt(squares))[:, None]
        self.weights[table][rows] -= total


def run_sums(part: np.ndarray, starts: np.ndarray, short: int = 16) -> np.ndarray:
    """Sums of the rows of part from each start to the next: most runs are short and are added up side by side."""
    ends = np.append(starts[1:], len(part))
    total, left = part[starts], np.flatnonzero(ends - starts > 1)
    for k in range(1, short):
        total[left] += part[starts[left] + k]
        left = left[ends[left] - starts[left] > k + 1]
    for i in left.tolist():
        total[i] += part[starts[i] + short : ends[i]].sum(0)
    return total


def numbered(texts: list[bytes | None], number: dict[bytes, int], other: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of texts one after the other, ends included, and where texts begin."""
    ids: list[int] = []
    first = []
    for text in texts:
        first.append(len(ids))
        ids.extend([number.get(w, other) for w in words_of(text)])
        ids.append(number.get(END, other))
    return np.array(ids, np.int64), np.array(first, np.int64)


def first_weights(s: Settings, head: list[tuple[bytes, int]], total: int) -> list[np.ndarray]:
    """Biases that give the counts' own probabilities, all else 0."""
    weights = [np.zeros(shape, np.float32) for shape in s.shapes]
    counts = np.zeros(s.words)
    top = [n for _, n in head[: s.words]]
    counts[: len(top)] = top
    weights[0][0] = np.log(np.concatenate((counts.reshape(s.classes - 1, -1).sum(1), [total - counts.sum()])) + 1)
    for i, (_, width, under) in enumerate(s.inner):
        n = counts.reshape(-1, width, under).sum(2)
        weights[4 + 3 * i][: len(n)] = np.where(n > 0, np.log(np.maximum(n, 1)), -20.0)
    return weights


def _blocks(s: Settings) -> list[tuple[int, int, int]]:
    return [(t, lo, min(lo + BLOCK_ROWS, rows)) for t, (rows, _) in enumerate(s.shapes) for lo in range(0, rows, BLOCK_ROWS)]


def train(texts: DataFrame, head: list[tuple[bytes, int]], total: int, s: Settings) -> list[np.ndarray]:
    """Weights after one pass over texts (text binary, slice int: the round that reads the row)."""
    weights, blocks = first_weights(s, head, total), _blocks(s)
    context = texts.sparkSession.sparkContext
    tasks = max(8, total // s.tokens_per_task)
    names = context.broadcast({w: i for i, (w, _) in enumerate(head[: s.words])})
    for turn in range(s.rounds):
        now = context.broadcast([w.tobytes() for w in weights])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = [np.frombuffer(b, np.float32).reshape(shape) for b, shape in zip(now.value, s.shapes)]
            net, seen = Net(s, [w.copy() for w in start]), 0
            ids, first, held = [], [], 0

            def take() -> None:
                nonlocal held, seen
                stream = np.concatenate(ids)
                begins = np.zeros(len(stream), bool)
                begins[np.concatenate(first)] = True
                for at in range(0, len(stream), TOKENS_PER_STEP):
                    net.step(stream[at : at + TOKENS_PER_STEP], begins[at : at + TOKENS_PER_STEP])
                seen += len(stream)
                ids.clear(), first.clear()
                held = 0

            for batch in batches:
                for text in batch.column(0):
                    got, begin = numbered([text.as_py()], names.value, s.words)
                    ids.append(got)
                    first.append(begin + held)
                    held += len(got)
                    if held >= TOKENS_PER_STEP:
                        take()
            if held:
                take()
            if seen:
                for b, (t, lo, hi) in enumerate(blocks):
                    change = (net.weights[t][lo:hi] - start[t][lo:hi]) * np.float32(seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([float(seen)]), pa.array([change.tobytes()], pa.binary())],
                        names=["block", "seen", "change"],
                    )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for b, n, change in zip(*(c.to_pylist() for c in batch.columns)):
                    part = np.frombuffer(change, np.float32)
                    if b in sums:
                        sums[b][0] += n
                        sums[b][1] += part
                    else:
                        sums[b] = [n, part.astype(np.float64)]
            for b, (n, change) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([n]), pa.array([(change / n).astype(np.float32).tobytes()], pa.binary())],
                    names=["block", "seen", "change"],
                )

        kind = "block int, seen double, change binary"
        # Each sum keeps one block of weights per key, however many tasks send one.
        moved = texts.filter(F.col("slice") == turn).select("text").coalesce(tasks).mapInArrow(run, kind)
        for r in moved.repartition(min(len(blocks), 32), "block").mapInArrow(add, kind).collect():  # ends the query, so its shuffle files go
            t, lo, hi = blocks[r.block]
            weights[t][lo:hi] += np.frombuffer(r.change, np.float32).reshape(hi - lo, -1)
        now.unpersist()
    return weights


@dataclass(frozen=True)
class Model:
    settings: Settings
    head: list[tuple[bytes, int]]
    counts: DataFrame
    tokens: int
    distinct: int
    weights: list[np.ndarray]


def fit(docs: DataFrame, held_out_mod: int = 7, held_out_is: int = 2, s: Settings = Settings()) -> Model:
    """Learns from all rows whose crc32(doc_id as text) mod held_out_mod is not held_out_is."""
    side = remainder(F.col("doc_id"), held_out_mod)
    slice_of = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(s.rounds)).cast("int")
    texts = docs.filter(side != held_out_is).select(F.col("text").cast("binary").alias("text"), slice_of.alias("slice"))
    counts = stored(count_words(texts.select("text")), "maxent-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    s = s.grown(distinct)
    head = head_of(counts, s.head_words)
    return Model(s, head, counts, tokens, distinct, train(texts, head, tokens, s))


def score(docs: DataFrame, model: Model, held_out_mod: int = 7, held_out_is: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Scores are log10 probabilities of the whole text and its end; a null text is the empty text (one token). Repeated
    rows are scored each; a null doc_id counts as the empty string in the split. Extra columns are ignored. Without any
    training row the one unknown word has probability 1 in both scores' bases. Empty tables give no rows.
    """
    s, spark = model.settings, docs.sparkSession
    base_of_all = math.log10(model.tokens + model.distinct + 1)
    inside = sum(n for _, n in model.head[: s.words])
    outside = math.log10(model.tokens - inside + max(0, model.distinct - s.words) + 1)
    shared: Broadcast = spark.sparkContext.broadcast(
        {"head": model.head, "weights": [w.tobytes() for w in model.weights]}
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "number" not in state:  # a worker process keeps the broadcast value for its later tasks
            state["number"] = {w: i for i, (w, _) in enumerate(state["head"])}
            state["logs"] = np.log10(np.array([n for _, n in state["head"]] + [0.0]) + 1)
        number, logs, none = state["number"], state["logs"], len(state["head"])
        net = Net(s, [np.frombuffer(b, np.float32).reshape(shape) for b, shape in zip(state["weights"], s.shapes)])
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, size, begin = [], 0, at
                while at < whole.num_rows and size < 1 << 19:  # bytes; a longer text is a part of its own
                    texts.append(whole.column(1)[at].as_py())
                    size += len(texts[-1] or b"")
                    at += 1
                tails, ids, first = [], [], []
                for text in texts:
                    words = words_of(text)
                    words.append(END)
                    got = [number.get(w, none) for w in words]
                    tails.append(Counter([w for w, i in zip(words, got) if i == none]) if none in got else {})
                    first.append(len(ids))
                    ids.extend(got)
                stream, starts = np.array(ids, np.int64), np.array(first, np.int64)
                flags = np.zeros(len(stream), bool)
                flags[starts] = True
                known = np.where(stream == none, s.words, np.minimum(stream, s.words))
                model_logs = np.empty(len(stream))
                for lo in range(0, len(stream), TOKENS_PER_SCORE):  # two tokens before give the history
                    back = max(0, lo - 2)
                    hi = lo + TOKENS_PER_SCORE
                    model_logs[lo:hi] = net.log_probs(known[back:hi], flags[back:hi])[lo - back :]
                counts_log = logs[stream]
                score_of = model_logs / math.log(10) + np.where(known == s.words, counts_log - outside, 0.0)
                lengths = np.diff(np.append(starts, len(stream)))
                keys = row + np.arange(len(texts))
                row += len(texts)
                entries = [(k, w, c) for k, tail in zip(keys.tolist(), tails) for w, c in tail.items()]
                n, m = len(texts), len(entries)

                def column(values: np.ndarray, none_of) -> pa.Array:
                    return pa.concat_arrays([pa.array(values), none_of])

                nulls = lambda t: pa.nulls(m, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.tolist() + [e[0] for e in entries], pa.int64()),
                        pa.array([None] * n + [e[1] for e in entries], pa.binary()),
                        column(lengths, pa.array([e[2] for e in entries], pa.int64())),
                        pa.concat_arrays([whole.column(0).slice(begin, n), nulls(whole.column(0).type)]),
                        column(np.add.reduceat((stream < none).astype(np.int64), starts), nulls(pa.int64())),
                        column(np.add.reduceat(counts_log - base_of_all, starts), nulls(pa.float64())),
                        column(np.add.reduceat(score_of, starts), nulls(pa.float64())),
                    ],
                    names=["row", "word", "n", "doc_id", "n_known", "base", "score"],
                )

    found = stored(
        docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
            run, f"row bigint, word binary, n bigint, doc_id {kind}, n_known bigint, base double, score double"
        ),
        "maxent-scores",
    )
    # A word that no training text has adds nothing: log10(0 + 1).
    tail = found.filter(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("times"))
    met = tail.join(model.counts, "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more")
    )
    more = F.coalesce(F.col("more"), F.lit(0.0))
    return (
        found.filter(F.col("word").isNull())
        .join(met, "row", "left")
        .select(
            "doc_id",
            (remainder(F.col("doc_id"), held_out_mod) == held_out_is).alias("held_out"),
            F.col("n").alias("n_tokens"),
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + more).alias("base_score"),
            (F.col("score") + more).alias("score"),
        )
    )
