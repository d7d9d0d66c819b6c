"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 32-bit hashes of single words, pairs of neighbours and pairs around one word; a feature counts once per
text. Training runs on a bounded sample of labelled rows, in shards whose states are averaged after every pass. L1 leaves
few weights, which are broadcast with their hashes, so features that carry no weight cost one table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.llm.common import forget, remainder, stored

TRAIN_ROWS = 24_000  # bound of the labelled sample; the rows with the smallest hashes of doc_id
REMEMBERED_WORDS = 1 << 17
SIEVE_BITS = 20
BLOCK = 1 << 18  # features whose states are averaged together


@dataclass(frozen=True)
class Settings:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    passes: int = 8
    shards: int = 4
    min_texts: int = 4  # a feature of the dictionary is in so many texts of the sample, whatever its size


class WordHashes(dict):
    """Word -> 64-bit hash without punctuation around the word; forgets everything when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.strip(b".,;:!?\"'()[]{}|*-"), 1)
        return found


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The 32-bit hashes of all features of a text, repeats included."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        skip = (h[:-2] * np.uint64(0x165667B19E3779F9)) ^ (h[2:] * np.uint64(0xD6E8FEB86659FD93))
    return (np.concatenate((h, pair, skip)) >> np.uint64(32)).astype(np.uint32)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def ftrl_pass(texts: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass of FTRL-proximal over texts (feature positions), in place; the last position is the bias."""
    bias = np.array([len(z) - 1])
    for at, label in zip(texts, labels):
        at = np.concatenate((at, bias))
        w = weights_of(z[at], n[at], s)
        w[-1] = -z[at[-1]] / ((s.beta + np.sqrt(n[at[-1]])) / s.alpha + s.l2)  # no L1 on the bias
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
        z[at] += g - sigma * w
        n[at] += g * g


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that may be learnt from: crc32(doc_id as text) mod 5 is not 0.

    At most `rows` of them, those with the smallest hashes of doc_id. Labels other than 0 and 1 are left out; of
    several labels of one document the largest counts.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The sample has at most `rows` rows of two numbers, whatever the table has.
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes in order, their weights, bias). Without usable labels: no features, bias 0."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(features(t.as_py(), hashes)).view(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "found"],
            )

    sample = stored(
        training_rows(docs, labels, rows).mapInArrow(extract, "doc_id string, toxic int, found array<int>"), "toxic-sample"
    )
    common = sample.select(F.explode("found").alias("f")).groupBy("f").count().filter(F.col("count") >= s.min_texts)
    # The dictionary is bounded by the sample: its features are at most the sample's features / min_texts.
    dictionary = np.sort(common.select("f").toArrow().column("f").to_numpy().view(np.uint32))
    shared = sample.sparkSession.sparkContext.broadcast(dictionary.tobytes())
    z, n = np.zeros(len(dictionary) + 1), np.zeros(len(dictionary) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            places = []
            for found in batch.column("found"):
                f = found.values.to_numpy().view(np.uint32)
                at = np.minimum(np.searchsorted(known, f), max(len(known) - 1, 0))
                places.append(at[known[at] == f].astype(np.int32) if len(known) else at[:0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "toxic", "at"])

    # Only the places of dictionary features travel on, dealt to shards once for all passes.
    dealt = stored(
        sample.mapInArrow(place, "doc_id string, toxic int, at array<int>").withColumn(
            "shard", F.pmod(F.xxhash64("doc_id"), F.lit(s.shards)).cast("int")
        ),
        "toxic-places",
    )
    forget(sample)
    for _ in range(s.passes):
        state = sample.sparkSession.sparkContext.broadcast((z.astype(np.float32).tobytes(), n.astype(np.float32).tobytes()))

        def learn(table: pa.Table) -> pa.Table:
            own_z, own_n = (np.frombuffer(x, np.float32).astype(float) for x in state.value)
            order = np.argsort(table.column("doc_id").to_pandas().to_numpy(str), kind="stable")
            texts = [at.values.to_numpy() for at in table.column("at")]
            labels_of = table.column("toxic").to_numpy()
            ftrl_pass([texts[i] for i in order], labels_of[order].astype(float), own_z, own_n, s)
            blocks = range(0, len(own_z), BLOCK)
            columns = {x: [own[lo : lo + BLOCK].astype(np.float32).tobytes() for lo in blocks] for x, own in (("z", own_z), ("n", own_n))}
            return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array([table.column("shard")[0].as_py()] * len(blocks), pa.int32()), **columns})

        def mean(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("shard").to_numpy())
            means = {x: np.mean([np.frombuffer(table.column(x)[i].as_py(), np.float32) for i in order.tolist()], axis=0, dtype=float) for x in ("z", "n")}
            return pa.table({"block": table.column("block")[:1], **{x: [m.tobytes()] for x, m in means.items()}})

        moved = dealt.groupBy("shard").applyInArrow(learn, "block bigint, shard int, z binary, n binary")
        # The driver gets the shards' mean, block by block, not each shard's state.
        for r in moved.groupBy("block").applyInArrow(mean, "block bigint, z binary, n binary").toLocalIterator():
            z[r.block : r.block + BLOCK], n[r.block : r.block + BLOCK] = np.frombuffer(r.z), np.frombuffer(r.n)
        state.destroy()
    w = weights_of(z[:-1], n[:-1], s)
    bias = float(-z[-1] / ((s.beta + np.sqrt(n[-1])) / s.alpha + s.l2))
    return dictionary[w != 0], w[w != 0], bias


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], carried: list[str]) -> DataFrame:
    """Columns c0, c1, .. (the carried ones), text and toxic_score of every row of docs."""
    keys, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((keys.tobytes(), weights.tobytes(), bias))
    names = [f"c{i}" for i in range(len(carried))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = np.frombuffer(shared.value[0], np.uint32), np.frombuffer(shared.value[1])
        mask = np.uint32((1 << SIEVE_BITS) - 1)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(known & mask).astype(np.int64)] = True
        hashes = WordHashes()
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                raw = text.as_buffer()
                f = features(raw.to_pybytes() if raw else b"", hashes)
                f = np.unique(f[sieve[(f & mask).astype(np.int64)]])
                at = np.minimum(np.searchsorted(known, f), max(len(known) - 1, 0))
                scores[i] = sigmoid(shared.value[2] + (w[at[known[at] == f]].sum() if len(f) else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "text", "toxic_score"])

    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carried, names)]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)), "text")
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "toxic_score double"]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null text is the empty text, whose score is that of the bias alone. A text is used whole. Null doc_ids have
    held_out by the empty string. One row per row of docs, whatever else it holds; an empty table gives no rows.
    """
    return _scored(docs, model, ["doc_id"]).select(
        F.col("c0").alias("doc_id"),
        (remainder(F.col("c0"), 5) == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the limit, with all their columns."""
    carried = [c for c in docs.columns if c != "text"]
    place = {c: f"c{i}" for i, c in enumerate(carried)}
    scored = _scored(docs, model, carried).filter(F.col("toxic_score") < limit)
    return scored.select(*(F.col(place.get(c, "text")).alias(c) for c in docs.columns))
