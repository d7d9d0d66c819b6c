"""Exact top-k by inner product with two cover trees, one over the index rows and one over the queries.

Each node has a centre, which is one of its points, and the radius that covers all its points. A pair of nodes is left
out if even the largest product that its radii allow is below the worst k-th score of the query node's queries; near the
root that spares whole groups of queries at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.llm import exact
from localexplain.llm.exact import bounded
from localexplain.llm.search import best, distinct_vectors, search, usable

SHARD_ROWS = 4096
LEAF_ROWS = 64
QUERY_LEAF_ROWS = 16
SHRINK = 1.6  # a child's radius against its parent's


class Node:
    __slots__ = ("lo", "hi", "centre", "radius", "norm", "children")

    def __init__(self, lo: int, hi: int, centre: np.ndarray, radius: float):
        self.lo, self.hi, self.centre, self.radius = lo, hi, centre, radius
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []


class CoverTree:
    """Points in tree order; a node owns order[lo:hi]. Children's centres are farther apart than the children's radius bound."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.leaf_rows = points, leaf_rows
        self.order = np.arange(len(points))
        self.root = self._node(0, len(points), 0) if len(points) else None
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            self._split(node)
            stack.extend(node.children)
        self.sorted = points[self.order]

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        difference = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", difference, difference))

    def _node(self, lo: int, hi: int, centre: int) -> Node:
        far = self._distances(centre, self.order[lo:hi])
        return Node(lo, hi, self.points[centre], float(far.max()) * (1 + 1e-12))

    def _split(self, node: Node) -> None:
        rows = self.order[node.lo : node.hi]
        if len(rows) <= self.leaf_rows or node.radius == 0:
            self.order[node.lo : node.hi] = np.sort(rows)
            return
        bound, at = node.radius / SHRINK, node.lo
        loose, groups = rows, []
        while len(loose):
            # The first point that no centre covers is the next centre; it takes what lies within the bound.
            near = self._distances(loose[0], loose) <= bound
            groups.append((loose[near], loose[0]))
            loose = loose[~near]
        # Points that nothing else is near would be leaves of one row: they share leaves around one of them.
        alone = [g for g, _ in groups if len(g) * 8 < self.leaf_rows]
        groups = [(g, c) for g, c in groups if len(g) * 8 >= self.leaf_rows]
        if alone:
            rest = np.concatenate(alone)
            groups += [(rest[i : i + self.leaf_rows], rest[i]) for i in range(0, len(rest), self.leaf_rows)]
        for group, centre in groups:
            self.order[at : at + len(group)] = group
            node.children.append(self._node(at, at + len(group), centre))
            at += len(group)


def dual_top_k(queries: np.ndarray, p_tree: CoverTree, k: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(positions, scores) of the k best points of a tree for each query, best first, ties to earlier points; and work done.

    Scores are whole numbers without rounding: int64, or Python's integers where products are too large for it. Positions
    are -1 where there are fewer than k points.
    """
    q_tree, points = CoverTree(queries, QUERY_LEAF_ROWS), p_tree.points
    positions = np.full((len(queries), k), -1, np.int64)
    work = {"pairs": len(queries) * len(points), "products": 0}
    # Lower than any product of vectors whose components are finite doubles.
    none = -(2**62) if bounded(queries, points) else -(2**2100)
    scores = np.full((len(queries), k), none, np.int64 if none == -(2**62) else object)
    if not len(queries) or not len(points):
        return positions, scores, work

    def most(a: Node, b: Node) -> float:
        value = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return value + 1e-9 * (abs(value) + (a.norm + a.radius) * (b.norm + b.radius))

    def products(a: Node, b: Node) -> None:
        q, p = q_tree.sorted[a.lo : a.hi], p_tree.sorted[b.lo : b.hi]
        new = exact.products(q, p)
        new = new if new.dtype == scores.dtype else new.astype(scores.dtype)
        work["products"] += new.size
        mine = slice(a.lo, a.hi)
        rows = np.flatnonzero(new.max(1) >= scores[mine, -1])
        if not len(rows):
            return
        where = np.broadcast_to(p_tree.order[b.lo : b.hi], new.shape)[rows]
        all_scores = np.concatenate((scores[mine][rows], new[rows]), axis=1)
        all_places = np.concatenate((positions[mine][rows], where), axis=1)
        by_place = np.argsort(np.where(all_places < 0, len(points), all_places), axis=1, kind="stable")
        by_score = np.argsort(-np.take_along_axis(all_scores, by_place, 1), axis=1, kind="stable")[:, :k]
        first = np.take_along_axis(by_place, by_score, 1)
        scores[a.lo + rows] = np.take_along_axis(all_scores, first, 1)
        positions[a.lo + rows] = np.take_along_axis(all_places, first, 1)

    stack = [(most(q_tree.root, p_tree.root), q_tree.root, p_tree.root)]
    while stack:
        bound, a, b = stack.pop()
        if bound < scores[a.lo : a.hi, -1].min():
            continue
        if not a.children and not b.children:
            products(a, b)
        elif b.children and (not a.children or b.radius >= a.radius):
            stack.extend(sorted(((most(a, c), a, c) for c in b.children), key=lambda x: x[0]))
        else:
            stack.extend(sorted(((most(c, b), c, b) for c in a.children), key=lambda x: x[0]))
    back = np.empty(len(queries), np.int64)
    back[q_tree.order] = np.arange(len(queries))
    return positions[back], scores[back], work


def top_k(rows: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every`, the k rows with the largest integer
    inner product, among all rows with another vec_id; ties go to the smaller vec_id, all rows if there are fewer.

    Components become floor(256 * x), scores are exact at any size; one that a long can't hold is an error. Vectors that are null or hold null or non-finite components, and null ids, take no
    part. Equal rows count once; rows of one vec_id with different vectors are candidates each, but never for each other.
    Vectors of different lengths are not compared. Extra columns are ignored; empty tables give no rows.
    """
    whole = usable(rows).withColumn("v", exact.whole(F.col("v")))
    queries = whole.filter(F.col("vec_id") % every == 0).distinct()

    index = distinct_vectors(whole, k + 1)
    found = search(index, queries, k, shard_rows, shard_rows, CoverTree, lambda tree, q: dual_top_k(q, tree, k + 1)[:2], "bigint", True)
    return best(found.distinct(), k, F.col("score").desc())
