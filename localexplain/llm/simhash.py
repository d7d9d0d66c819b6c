"""Near-duplicates by SimHash: fingerprints of word shingles, linked by meeting in the middle of a Hamming ball.

Every distinct fingerprint emits all values within half the radius; two fingerprints within the radius share one of
them. At most 65 different fingerprints lie within one bit of a value, so no bucket can grow, whatever the number of
copies. Inside a bucket neighbours in order of value are linked: all of a bucket lie within the radius of each other, so
that connects what all pairs would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.llm.common import stored
from localexplain.llm.components import components

SHINGLE_BLOCK = 1 << 16


def shingle_hashes(text: bytes, words_per_shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white space characters
    if not words:
        return np.empty(0, np.uint64)
    clean, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return np.array([hash_of(clean, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return np.fromiter(
        (hash_of(clean[a:b], seed) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist())),
        np.uint64,
        len(words) - words_per_shingle + 1,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 bits that more than half the hashes have set, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLE_BLOCK):
        part = np.ascontiguousarray(hashes[at : at + SHINGLE_BLOCK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp bigint): a null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py() or b"", words_per_shingle, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _flips(fp: Column, radius: int) -> Column:
    """fp and all values that differ from it in up to radius bits."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(64)} | set(masks))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m))


def ball_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp that connect all pairs within distance (even: 2 or 4)."""
    near = prints.select(F.explode(_flips(F.col("fp"), distance // 2)).alias("variant"), "fp")
    chained = near.withColumn("other", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    met = chained.filter(F.col("other").isNotNull()).select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()
    return met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    One row per row of docs; repeated rows share a component, extra columns are ignored. Texts without words (null,
    empty, white space) have fingerprint 0 and link like others. A null doc_id is a document that never names a
    component, unless nothing else is in it (then component_id is null). Empty tables give no rows.
    """
    prints = stored(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(ball_links(distinct, distance), "simhash")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = roots.select(F.col("root")).distinct()
    # Only fingerprints that have a link need the minimum over their component.
    least = (
        rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    )
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
