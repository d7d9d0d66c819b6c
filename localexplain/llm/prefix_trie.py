"""The prefix trie of conversations: identical conversations collapsed into weighted sequences, leaves by anti-join, weighted prefixes.

Turns travel as (hash, number of words), never as texts. A node is known by a chained SHA-256 of its turns. The nodes whose
smallest member is conversation s are the lowest ones on the path of s, so sums over subtrees need no walk: every sequence
carries the running sum of its own nodes from the bottom up, and one partial aggregation by node adds the sequences up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.llm.common import join_by_share, n_words, stored

ROOT = hashlib.sha256(b"").digest()
FAMILY = 20  # conversations c - c % FAMILY .. share the head of the first
HEADS = 4  # a conversation takes 0 .. HEADS - 1 turns from there
BLOCK_BITS = 12  # ids of a sequence's ends are sorted in blocks of this many bits


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, words) of every row with a conv_id: the hash stands for role and text, null for empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length in front keeps role and text apart.
    said = F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text)
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("hash"),
        n_words(text).alias("words"),
    ).filter(F.col("conv_id").isNotNull())


def heads_taken(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, hash, words, taken): place 0 for turns taken over from the family's first conversation, 1 for own.

    taken is the number of own turns to leave out at the start. Heads are offered to all ids of the family, existing or not:
    that is a bounded number of rows for each head, and needs no join.
    """
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "hash")
    offered = F.sequence(
        F.when(F.col("conv_id") > 0, F.col("conv_id")).otherwise(F.col("conv_id") - (FAMILY - 1)),
        F.when(F.col("conv_id") < 0, F.col("conv_id")).otherwise(F.col("conv_id") + (FAMILY - 1)),
    )
    heads = (
        turns.filter(F.col("conv_id") % FAMILY == 0)
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") < HEADS)
        .withColumn("conv_id", F.explode(offered))
        .filter(F.col("n") <= heads_taken(F.col("conv_id")))
    )
    taken = heads_taken(F.col("conv_id"))
    return heads.select("conv_id", F.lit(0).alias("place"), F.col("n").cast("bigint").alias("turn"), "hash", "words", taken.alias("taken")).unionByName(
        turns.select("conv_id", F.lit(1).alias("place"), "turn", "hash", "words", taken.alias("taken"))
    )


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, last): the prefixes of every rebuilt conversation, from depth 1.

    A conversation without any turn gives one row of depth 0; last marks its longest prefix. A task reads its
    conversations in order and holds one row and at most HEADS - 1 heads of each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "node", "parent", "words", "last"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        out: list[list] = [[] for _ in names]
        conv, exists, own, depth, node = None, False, 0, 0, ROOT
        held: list[tuple] = []  # rows of this conversation that are not yet written: heads before the first own turn, then one

        def write(row: tuple, last: bool) -> None:
            for column, value in zip(out, (*row, last)):
                column.append(value)

        def close() -> None:
            if exists:
                for row in held[:-1]:
                    write(row, False)
                write(held[-1] if held else (conv, 0, ROOT, None, 0), True)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for c, place, hashed, words, taken in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if c != conv:
                    close()
                    conv, exists, own, depth, node = c, False, 0, 0, ROOT
                    held = []
                if place:
                    exists, own = True, own + 1
                    if own <= taken:
                        continue
                parent, depth = node, depth + 1
                node = hashlib.sha256(parent + hashed).digest()
                if exists:
                    for row in held:
                        write(row, False)
                    held = []
                held.append((c, depth, node, parent, words))
            yield flush()
        close()
        yield flush()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.col("turn").asc_nulls_first(), "hash")
    return ordered.select("conv_id", "place", "hash", "words", "taken").mapInArrow(
        run, "conv_id bigint, depth bigint, node binary, parent binary, words bigint, last boolean"
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): SHA-256 of the node's ids in ascending order, joined by commas.

    Ids are sorted and joined in blocks of neighbouring ids first, on all tasks; the task of a node then only streams the
    blocks' strings through one hash, so a node with a third of all ids is neither held nor sorted anywhere.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("node", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def closed(nodes: list, digests: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])

        for batch in batches:
            nodes: list[bytes] = []
            digests: list[str] = []
            for key, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key == node:
                    state.update(b",")
                else:
                    if state:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = key, hashlib.sha256()
                state.update(text.encode())
            yield closed(nodes, digests)
        if state:
            yield closed([node], [state.hexdigest()])

    ordered = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node: node, parent (hashes), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns of a conversation are ordered by turn (null first), ties by a hash of role and text; equal rows are turns of
    their own. Null roles and texts are empty. Rows without a conv_id take no part. The root exists if any conversation
    does; an empty table gives no rows. Extra columns are ignored. Paths and weighted sequences are stored in the shared
    folder, some 80 bytes for each turn.
    """
    path = stored(paths(rebuilt(turn_rows(turns))), "paths")

    # Identical conversations become one sequence, known by its smallest conversation.
    last = path.filter("last")
    sequences = last.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"))
    chosen = stored(sequences, "sequences")
    steps = path.join(chosen.select("conv_id", "weight"), "conv_id")
    inner = steps.filter(~F.col("last")).select("node").union(steps.filter("depth > 0").select(F.lit(ROOT).cast("binary"))).distinct()
    leaves = chosen.join(inner, "node", "left_anti").select("conv_id", F.lit(1).cast("bigint").alias("leaf"))
    on_path = steps.filter("depth > 0").select("conv_id", "depth", "node", "parent", "words", "weight")
    top = chosen.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("words"), "weight")
    weighted = stored(on_path.unionByName(top), "weighted")

    # Weighted prefixes: each node once, with its members.
    nodes = stored(
        weighted.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            F.first("parent").alias("parent"),
            F.first("words").alias("words"),
            F.sum("weight").alias("n_convs"),
        ),
        "nodes",
    )
    # A node stands at (smallest member, depth) and nowhere else: its own saving is put there and summed from the bottom up.
    saving = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    summed = (
        weighted.join(saving, ["conv_id", "depth"], "left")
        .join(leaves, "conv_id", "left")
        .select("node", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.sum(F.coalesce("saving", F.lit(0))).over(below).alias("saving"))
        .groupBy("node")
        .agg(F.sum("leaf").cast("bigint").alias("n_leaves"), F.sum("saving").cast("bigint").alias("saved_tokens"))
    )
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.join(children, "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    whole = (
        nodes.join(summed, "node")
        .join(children, "node", "left")
        .join(end_hashes(last.select("node", "conv_id")), "node", "left")
        .select(
            "node",
            "parent",
            "conv_id",
            "depth",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
    return join_by_share(whole, parents, "parent", nodes.count())


def digests(turns: DataFrame) -> DataFrame:
    """The contract's columns."""
    return trie(turns).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
