"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. For an anchor a and a row x, the triangle
inequality on the sphere puts the angle between them into [max |A_j - X_j|, min (A_j + X_j)], so the inner product lies in
an interval of |a| |x| times cosines, widened by more than rounding can do. Only rows whose interval meets what an anchor
still looks for are scored, in whole numbers. The same intervals of whole cells and blocks of anchors decide which cells
an anchor is sent to at all; a first round on a few cells gives every anchor a score that the rest has to beat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localexplain.llm.common import stored
from localexplain.llm.exact import LONG_MAX, LONG_MIN, as_long, products, whole
from localexplain.llm.search import usable

REFERENCES = 16
SAMPLE_ROWS = 1024  # rows that the reference directions are fitted to; results don't depend on them
CELL_ROWS = 4096
BLOCK_ROWS = 256
CHUNK = 4096  # summaries of cells or blocks that one routing task compares
PROBES = 3  # cells of a first round
BLOCKS_PER_TASK = 64
CELL = ["size", "label", "ref", "part"]
BLOCK = ["size", "a_label", "a_ref", "a_part"]


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and between which hundredths of the positive's score a negative has to score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90

    def window(self, positive: int) -> tuple[int, int]:
        """The whole scores s with low * positive <= 100 * s <= high * positive, first and last; empty if first > last."""
        return -((-self.low * positive) // 100), (self.high * positive) // 100


def references(sample: list[list[float]], size: int) -> np.ndarray:
    """REFERENCES directions for vectors of one length: centres of the sampled directions, spread as far as they go."""
    pick = np.random.default_rng(size)
    if size == 0:
        return np.zeros((REFERENCES, 0))
    x = np.array([v for v in sample if len(v) == size and any(v)], float).reshape(-1, size)
    x = np.concatenate((x, pick.normal(size=(max(0, REFERENCES - len(x)), size))))
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < REFERENCES:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(4):
        mine = np.argmax(x @ centres.T, axis=1)
        for j in range(REFERENCES):
            total = x[mine == j].sum(0)
            if np.linalg.norm(total) > 1e-9:
                centres[j] = total / np.linalg.norm(total)
    return centres


def norms(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the vectors divided by them (zero vectors as they are), without overflow of the squares."""
    top = np.abs(v).max(axis=1, initial=0)
    scaled = v / np.where(top > 0, top, 1)[:, None]
    length = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    return top * length, scaled / np.where(length > 0, length, 1)[:, None]


def slack(size: int) -> float:
    """More than the error of a stored angle: the error of a cosine is that of `size` sums, arccos may take its root."""
    return 2 * math.sqrt(4 * (size + 8) * np.finfo(float).eps)


def bounds(a_lo, a_hi, a_least, a_most, x_lo, x_hi, x_least, x_most, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the inner products of every a with every x, from ranges of their angles (rows x references) and norms.

    A single vector is a range of one value. Where norms are too large for doubles the interval is unbounded.
    """
    near, far = np.zeros((len(a_lo), len(x_lo))), np.full((len(a_lo), len(x_lo)), np.pi)
    for j in range(a_lo.shape[1]):
        np.maximum(near, a_lo[:, j, None] - x_hi[None, :, j], out=near)
        np.maximum(near, x_lo[None, :, j] - a_hi[:, j, None], out=near)
        np.minimum(far, a_hi[:, j, None] + x_hi[None, :, j], out=far)
        # Going round the other side: the angle is at most 2 pi minus the sum.
        np.minimum(far, 2 * np.pi - a_lo[:, j, None] - x_lo[None, :, j], out=far)
    error = 2 * slack(size)
    most, least = np.cos(np.maximum(near - error, 0)), np.cos(np.minimum(far + error, np.pi))
    with np.errstate(over="ignore", invalid="ignore"):
        big, small = a_most[:, None] * x_most[None], a_least[:, None] * x_least[None]
        high = np.where(most > 0, big, small) * most
        low = np.where(least > 0, small, big) * least
        margin = big * 1e-9 + 1
        return np.nan_to_num(low - margin, nan=-np.inf, neginf=-np.inf), np.nan_to_num(high + margin, nan=np.inf, posinf=np.inf)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def angled(rows: DataFrame, sample: list[list[float]], cells: int) -> DataFrame:
    """rows with norm, angles and ref, the nearest of the first `cells` references."""
    known = {n: references(sample, n) for n in {len(v) for v in sample}}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                if n not in known:
                    known[n] = references([], n)
                length, unit = norms(matrix(part.column("v")))
                cosines = np.clip(unit @ known[n].T, -1, 1)
                angles = np.arccos(cosines)
                flat = pa.ListArray.from_arrays(np.arange(len(angles) + 1, dtype=np.int32) * REFERENCES, pa.array(angles.ravel()))
                ref = pa.array(np.argmax(cosines[:, :cells], axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(length), flat, ref], names=[*part.schema.names, "norm", "angles", "ref"]
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, norm double, angles array<double>, ref int")


def parts(rows: DataFrame, key: list[str], at_most: int, by: Column, name: str) -> DataFrame:
    """rows with a part number within their key, so that a (key, part) has about at_most rows."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / at_most).cast("int").alias("n_parts"))
    # One row for each label and reference: small, but labels are the table's, so the planner decides how to join.
    numbered = rows.join(counts, key).withColumn(name, F.pmod(F.xxhash64(by), F.col("n_parts")).cast("int"))
    return numbered.drop("n_parts")


def summary(rows: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """One row for each key: ranges of angles and norms."""
    lows = F.array(*(F.min(F.col("angles")[j]) for j in range(REFERENCES)))
    highs = F.array(*(F.max(F.col("angles")[j]) for j in range(REFERENCES)))
    return rows.groupBy(*key).agg(
        lows.alias("lows"), highs.alias("highs"), F.min("norm").alias("least"), F.max("norm").alias("most"), *more
    )


def route(blocks: DataFrame, cells: DataFrame, same_label: bool) -> DataFrame:
    """(block, cell, high): the pairs whose products can lie between want_low and want_high of the block; high: their bound.

    Summaries meet in chunks: blocks and cells are thousands of times fewer than rows, and tasks hold CHUNK of each.
    """
    n_cells, n_blocks = max(1, math.ceil(cells.count() / CHUNK)), max(1, math.ceil(blocks.count() / CHUNK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("b", F.pmod(F.xxhash64(*BLOCK), F.lit(n_blocks))).withColumn("c", numbers(n_cells))
    right = cells.withColumn("c", F.pmod(F.xxhash64(*CELL), F.lit(n_cells))).withColumn("b", numbers(n_blocks))
    names = [*BLOCK, *CELL[1:], "high"]

    def compare(asks: pa.Table, points: pa.Table) -> pa.Table:
        if asks.num_rows and points.num_rows:
            at = [(matrix(t.column("lows")), matrix(t.column("highs")), t.column("least").to_numpy(), t.column("most").to_numpy()) for t in (asks, points)]
            low, high = bounds(*at[0], *at[1], asks.column("size")[0].as_py())
            mine, theirs = asks.column("a_label").to_numpy(), points.column("label").to_numpy()
            pair = (mine[:, None] == theirs[None]) == same_label
            pair &= (low <= asks.column("want_high").to_numpy()[:, None]) & (high >= asks.column("want_low").to_numpy()[:, None])
            a, x = np.nonzero(pair)
            columns = [*(asks.column(c).take(a) for c in BLOCK), *(points.column(c).take(x) for c in CELL[1:]), pa.array(high[a, x])]
        else:
            columns = [[]] * len(names)
        kinds = [pa.int32()] * (len(names) - 1) + [pa.float64()]
        return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    schema = ", ".join(f"{n} int" for n in names[:-1]) + ", high double"
    return left.groupBy("size", "b", "c").cogroup(right.groupBy("size", "b", "c")).applyInArrow(compare, schema)


Work = Callable[[dict, dict], list[tuple]]


def meet(index: DataFrame, anchors: DataFrame, pairs: DataFrame, work: Work, schema: str, columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """work(cell, block) for every pair of pairs: a task reads a cell, then the blocks sent to it one after another.

    index rows are moved once for each BLOCKS_PER_TASK blocks that their cell gets, anchors once for each of their cells.
    """
    groups = Window.partitionBy(*CELL).orderBy(*BLOCK)
    numbered = pairs.select(*BLOCK, *CELL[1:]).distinct().withColumn("group", F.floor((F.row_number().over(groups) - 1) / BLOCKS_PER_TASK).cast("int"))
    copies = numbered.select(*CELL, "group").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    fields = ["v", "norm", "angles"]
    left = index.join(copies, CELL).select(
        *CELL, "group", F.lit(-1).alias("a_label"), F.lit(-1).alias("a_ref"), F.lit(-1).alias("a_part"), F.lit(0).alias("tag"), "ids", *fields,
        none("array<bigint>").alias("lows"), none("array<bigint>").alias("highs"),
    )
    right = anchors.join(numbered, BLOCK).select(
        *CELL, "group", *BLOCK[1:], F.lit(1).alias("tag"), F.array("vec_id", "row").alias("ids"), *fields, "lows", "highs"
    )
    keys = [*CELL, "group", "tag", *BLOCK[1:]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, cell = None, [], None
        names = [n for n, _ in columns]

        def finish() -> list[tuple]:
            nonlocal cell
            table = pa.Table.from_batches(pieces)
            loaded = {
                "place": current[:5], "size": current[0], "v": matrix(table.column("v")), "norm": table.column("norm").to_numpy(),
                "angles": matrix(table.column("angles")), "ids": table.column("ids").to_pylist(),
            }
            if current[5] == 0:
                cell = loaded
                return []
            loaded["lows"], loaded["highs"] = table.column("lows").to_pylist(), table.column("highs").to_pylist()
            return work(cell, loaded) if cell is not None and cell["place"] == loaded["place"] else []

        def written(rows: list[tuple]) -> pa.RecordBatch:
            values = list(zip(*rows)) or [[] for _ in columns]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, columns)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for begin, end in zip(cuts, cuts[1:]):
                key = tuple(at[begin].tolist())
                if key != current and pieces:
                    yield written(finish())
                    pieces = []
                current = key
                pieces.append(batch.slice(begin, end - begin))
        if pieces:
            yield written(finish())

    both = left.unionByName(right).repartition(*CELL, "group").sortWithinPartitions(*keys)
    return both.mapInArrow(run, schema)


def overlapping(cell: dict, block: dict, i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of the cell whose interval with anchor i meets one of the anchor's windows."""
    found = np.zeros(low.shape[1], bool)
    for first, last in zip(block["lows"][i], block["highs"][i]):
        if first <= last:
            found |= (high[i] >= first) & (low[i] <= last)
    return np.flatnonzero(found)


def pick(scores: np.ndarray, at: np.ndarray, cell: dict, anchor: int, first: int, last: int, k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best rows among those of the cell at `at` with scores from first to last, best first."""
    inside = np.flatnonzero((scores >= first) & (scores <= last))
    if len(inside) > 4 * k:
        # Vectors below the (k + 1)-th best score can't give a row: one vector may only hold the anchor's own id.
        least = np.partition(scores[inside], len(inside) - k - 1)[len(inside) - k - 1]
        inside = inside[scores[inside] >= least]
    rows = [(int(scores[p]), member) for p in inside.tolist() for member in cell["ids"][at[p]] if member != anchor]
    rows.sort(key=lambda r: (-r[0], r[1]))
    return rows[:k]


def scorer(k: int) -> Work:
    """The work of meet(): (vec_id, row, window, other, score) of the k best rows of the cell in each window of each anchor."""

    def work(cell: dict, block: dict) -> list[tuple]:
        single = (block["angles"], block["angles"], block["norm"], block["norm"])
        low, high = bounds(*single, cell["angles"], cell["angles"], cell["norm"], cell["norm"], cell["size"])
        out = []
        for i, (anchor, row) in enumerate(block["ids"]):
            at = overlapping(cell, block, i, low, high)
            if not len(at):
                continue
            scores = products(block["v"][i : i + 1], cell["v"][at])[0]
            for w, (first, last) in enumerate(zip(block["lows"][i], block["highs"][i])):
                if first <= last:
                    found = pick(scores, at, cell, anchor, first, last, k)
                    out += [(anchor, row, w, other, s) for (_, other), s in zip(found, as_long(s for s, _ in found))]
        return out

    return work


FOUND = [("vec_id", pa.int64()), ("row", pa.int64()), ("window", pa.int32()), ("other", pa.int64()), ("score", pa.int64())]
FOUND_SCHEMA = "vec_id bigint, row bigint, window int, other bigint, score bigint"


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id", "row", "window").orderBy(F.col("score").desc(), "other")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def raised(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """anchors whose windows begin at the k-th score found in them, where k were found."""
    kth = found.groupBy("vec_id", "row", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
    floors = kth.groupBy("vec_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))
    lows = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w), low)))
    return anchors.join(floors, ["vec_id", "row"], "left").withColumn("lows", lows).drop("kth")


def rounds(index: DataFrame, cells: DataFrame, anchors: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
    """(vec_id, row, window, rank, other, score): the k best rows in every window of every anchor, exact.

    First the PROBES cells with the highest bounds for a block, then those that can still beat what was found there.
    """

    def wants(asked: DataFrame) -> DataFrame:
        used = F.filter(F.arrays_zip("lows", "highs"), lambda w: w["lows"] <= w["highs"])
        asked = asked.withColumn("used", used).filter(F.size("used") > 0)
        low = F.min(F.array_min(F.transform("used", lambda w: w["lows"]))).cast("double").alias("want_low")
        high = F.max(F.array_max(F.transform("used", lambda w: w["highs"]))).cast("double").alias("want_high")
        return summary(asked, BLOCK, low, high)

    def search(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        return meet(index, asked, pairs, scorer(k), FOUND_SCHEMA, FOUND)

    pairs = stored(route(wants(anchors), cells, same_label), f"{name}-pairs")
    order = Window.partitionBy(*BLOCK).orderBy(F.col("high").desc(), *CELL)
    probed = pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PROBES).drop("n")
    first = stored(best(search(anchors, probed), k), f"{name}-first")
    again = stored(raised(anchors, first, k), f"{name}-anchors")
    left = route(wants(again), cells, same_label).drop("high").join(probed.drop("high"), [*BLOCK, *CELL[1:]], "left_anti")
    return stored(best(first.drop("rank").unionByName(search(again, left)), k), name)


def mine(rows: DataFrame, every: int = 100, rule: Rule = Rule(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows whose vec_id is divisible by `every`.

    Components become floor(256 * x); a score is an integer inner product, and higher scores come first, ties by smaller
    vec_id. An anchor's positives are its first rule.positives rows of its label; each positive's negatives are the first
    rule.negatives rows of other labels between rule.low and rule.high hundredths of the positive's score. Fewer if there
    are no more; none where the positive's score is negative.

    Rows with a null label, id or vector, or with null or non-finite components, take no part. Equal rows count once; rows
    of one vec_id that differ are anchors and candidates each, but never for each other. Vectors of different lengths are
    not compared. Extra columns are ignored; empty tables give no rows. Scores are exact at any size; one that a long can't
    hold is an error. Angles and rounds are stored in the shared folder. Equal vectors of one label are searched once, with
    as many ids as a result can need, so a vector that a third of the rows share is one candidate.
    """
    kept = max(rule.positives, rule.negatives) + 1
    labelled = usable(rows.filter(F.col("label").isNotNull()), F.col("label").cast("int").alias("label"))
    flat = labelled.withColumn("v", whole(F.col("v"))).distinct()
    order = Window.partitionBy("label", "v").orderBy("vec_id")
    distinct = (
        flat.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= kept)
        .groupBy("label", "v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("size", F.size("v"))
    )
    sampled = [list(r.v) for r in flat.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE_ROWS).collect()]
    counted = flat.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).first()
    regions = min(REFERENCES, max(1, math.ceil(counted.n / (max(1, counted.labels) * cell_rows))))
    index = stored(parts(angled(distinct, sampled, regions), CELL[:-1], cell_rows, F.col("v"), "part"), "cells")
    cells = stored(summary(index, CELL), "summaries")

    asked = flat.filter(F.col("vec_id") % every == 0).withColumn("size", F.size("v")).withColumn("row", F.xxhash64("label", "v"))
    blocks = parts(angled(asked, sampled, regions), CELL[:-1], BLOCK_ROWS, F.col("vec_id"), "part")
    for mine_name, name in zip(BLOCK[1:], CELL[1:]):
        blocks = blocks.withColumnRenamed(name, mine_name)
    all_scores = lambda x: F.array(F.lit(x).cast("bigint"))
    anchors = stored(blocks.withColumn("lows", all_scores(LONG_MIN)).withColumn("highs", all_scores(LONG_MAX)), "anchors")

    positives = rounds(index, cells, anchors, rule.positives, True, "positives")
    # One window for each positive, at its place; whole hundredths round inwards.
    low = F.ceil(F.col("score").cast("decimal(19,0)") * rule.low / 100).cast("bigint")
    high = F.floor(F.col("score").cast("decimal(19,0)") * rule.high / 100).cast("bigint")
    windows = positives.groupBy("vec_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("windows")
    )
    with_windows = anchors.drop("lows", "highs").join(windows, ["vec_id", "row"])
    with_windows = with_windows.withColumn("lows", F.col("windows.low")).withColumn("highs", F.col("windows.high")).drop("windows")
    negatives = rounds(index, cells, stored(with_windows, "windows"), rule.negatives, False, "negatives")
    found = negatives.select("vec_id", "row", (F.col("window") + 1).alias("place"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        positives.select("vec_id", "row", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(found, ["vec_id", "row", "place"])
        .select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
