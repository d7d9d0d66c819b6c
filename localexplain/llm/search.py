"""What the vector searches share: usable vectors, distinct vectors, shards that read queries block by block, best rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.llm.exact import as_long

Prepare = Callable[[np.ndarray], Any]
Match = Callable[[Any, np.ndarray], tuple[np.ndarray, np.ndarray]]
BLOCKS_PER_TASK = 64


def usable(rows: DataFrame, *more: Column) -> DataFrame:
    """(vec_id bigint, v array<double>, more) without null ids and vectors that are null or hold null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than infinity in Spark
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), *more).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite
    )


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(v, ids): every different vector once with its smallest vec_ids, `ids` at most.

    A search for k rows never needs more than k + 1 copies of a vector, so equal rows beyond that can't be in any result.
    """
    numbered = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    return numbered.filter(F.col("n") <= ids).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of each query that come first by score, then vec_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy().reshape(len(whole), -1)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of rows with equal keys, in the order they come; one run is held at a time."""
    current, pieces = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(at[begin].tolist())
            if pieces and key != current:
                yield current, pa.Table.from_batches(pieces)
                pieces = []
            current = key
            pieces.append(batch.slice(begin, end - begin))
    if pieces:
        yield current, pa.Table.from_batches(pieces)


def magnitude(v: Column) -> Column:
    """A number that vectors share whose largest components are within a factor of 2^32 or so; there are some 70 of them."""
    return F.coalesce(F.floor(F.log2(F.array_max(F.transform(v, F.abs))) / 32), F.lit(0)).cast("int")


def search(
    index: DataFrame, queries: DataFrame, k: int, shard_rows: int, block_rows: int, prepare: Prepare, match: Match, score: str,
    first_is_high: bool, band: Column | None = None,
) -> DataFrame:
    """(query_id, vec_id, score): in every shard of the index the best k rows of every query.

    index is (v, ids) as distinct_vectors() makes it, queries (vec_id, v). Shards hold shard_rows vectors of one length and
    one band (an int of the vector with few values) each. A task reads a shard, prepares it once and then takes the queries
    in blocks of block_rows, one block at a time; index rows are moved again only for each BLOCKS_PER_TASK blocks.
    match(prepared, query vectors) gives for a block of queries the positions and scores of the k + 1 best index vectors
    each (position -1: none), best first; positions are in order of the vectors' smallest ids.
    """
    rows, asked = index.count(), queries.count()
    shards, blocks = max(1, math.ceil(rows / shard_rows)), max(1, math.ceil(asked / block_rows))
    groups = math.ceil(blocks / BLOCKS_PER_TASK)

    def dealt(column: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("size")
    left = index.select("v", "ids", size, (F.lit(0) if band is None else band).alias("band"), dealt(F.col("v"), shards).alias("shard"))
    bands = [r.band for r in left.select("band").distinct().collect()] if band is not None else [0]
    left = left.select("*", numbers(groups).alias("group"), F.lit(0).alias("tag"), F.lit(-1).alias("block"), F.lit(0).cast("bigint").alias("id"))
    right = queries.select("vec_id", "v", size, dealt(F.col("vec_id"), blocks).alias("block"))
    right = right.select("*", F.explode(F.array(*map(F.lit, bands or [0]))).alias("band"), (F.col("block") % groups).alias("group"))
    right = right.select("*", numbers(shards).alias("shard"))
    columns = ["size", "band", "shard", "group", "tag", "block", "id", "ids", "v"]
    right = right.withColumns({"tag": F.lit(1), "id": F.col("vec_id"), "ids": F.lit(None).cast("array<bigint>")})
    kind = pa.int64() if score == "bigint" else pa.float64()
    keys = columns[:6]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, prepared = None, [], None
        for key, table in runs(batches, keys):
            if key[4] == 0:
                ids = table.column("ids").to_pylist()
                order = np.argsort(np.array([i[0] for i in ids], np.int64), kind="stable")
                shard, members = key[:4], [ids[o] for o in order.tolist()]
                prepared = prepare(matrix(table.column("v"))[order])
                continue
            if key[:4] != shard:
                continue  # no vector of this length, band and shard
            out: list[list] = [[], [], []]
            for q, positions, values in zip(table.column("id").to_pylist(), *match(prepared, matrix(table.column("v")))):
                found = [(v, m) for p, v in zip(positions.tolist(), values.tolist()) if p >= 0 for m in members[p] if m != q]
                found.sort(key=lambda m: (-m[0] if first_is_high else m[0], m[1]))
                for value, member in found[:k]:
                    out[0].append(q)
                    out[1].append(member)
                    out[2].append(value)
            scores = as_long(out[2]) if score == "bigint" else out[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(scores, kind)], names=["query_id", "vec_id", "score"]
            )

    both = left.select(*columns).unionByName(right.select(*columns)).repartition(*keys[:4]).sortWithinPartitions(*keys)
    return both.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
