"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Building: greedy searches from the middle point propose neighbours; of these, the nearest is kept and all that lie
much nearer to it than to the point itself are dropped, and so on (relaxed distance pruning), which leaves edges in many
directions. Edges also lead back, pruned again where a point has too many. Points are handled in batches, so searches
and prunings are array operations. Queries run a beam search in every shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localexplain.llm.search import best, distinct_vectors, magnitude, search, usable

SHARD_ROWS = 8192
DEGREE = 24
BUILD_BEAM = 40
QUERY_BEAM = 80
RELAX = 1.2
BATCH = 256


def distances(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of p from v in double precision, from differences, without overflow of squares."""
    far = p - v
    top = float(np.abs(far).max(initial=0))
    if top < 1e150 and (top > 1e-140 or top == 0):
        return np.sqrt((far * far).sum(1))
    power = 2.0 ** -np.frexp(top)[1]  # exact
    return np.sqrt(((far * power) ** 2).sum(1)) / power


class Graph:
    """Edges of each point, -1 where there are fewer than the width (twice the degree; longer lists are pruned).

    Points are seen from their median and in units of the farthest component from it, so squared norms neither cancel nor
    overflow wherever the points lie.
    """

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 11):
        self.centre = np.median(points, axis=0) if len(points) else np.zeros(points.shape[1])
        self.unit = float(np.abs(points / 2 - self.centre / 2).max(initial=0)) or 1.0
        self.x = self.seen_from_centre(points)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        n = len(points)
        self.degree, self.width = degree, 2 * degree
        self.edges = np.full((n, self.width), -1, np.int32)
        self.start = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1)))
        random = np.random.default_rng(seed)
        if n > 1:
            few = min(degree, n - 1)
            first = random.integers(0, n - 1, (n, few))
            self.edges[:, :few] = first + (first >= np.arange(n)[:, None])
        for a in (1.0, relax):
            order = random.permutation(n)
            for lo in range(0, n, BATCH):
                self._improve(order[lo : lo + BATCH], beam, a)

    def seen_from_centre(self, vectors: np.ndarray) -> np.ndarray:
        """Halves, as a difference may be twice the largest double; a far query is cut off at a distance no point has."""
        return np.clip((vectors / 2 - self.centre / 2) / self.unit, -1e100, 1e100)

    def _squares(self, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of vectors (b, d) to points ids (b, m)."""
        dots = np.matmul(self.x[ids], vectors[:, :, None])[:, :, 0]
        return np.maximum(norms[:, None] + self.norms[ids] - 2 * dots, 0)

    def walk(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of many vectors at once: (ids, squared distances) of the beam, nearest first, -1 at its end."""
        b, rows = len(vectors), np.arange(len(vectors))
        norms = np.einsum("ij,ij->i", vectors, vectors)
        ids = np.full((b, beam), -1, np.int64)
        far = np.full((b, beam), np.inf, self.x.dtype)
        done = np.zeros((b, beam), bool)
        seen = np.zeros((b, len(self.x)), bool)
        ids[:, 0] = self.start
        far[:, 0] = self._squares(vectors, norms, ids[:, :1])[:, 0]
        seen[:, self.start] = True
        active = rows
        while len(active):
            open_far = np.where(done[active], np.inf, far[active])
            best_at = open_far.argmin(1)
            more = np.isfinite(open_far[np.arange(len(active)), best_at])
            active, best_at = active[more], best_at[more]
            if not len(active):
                break
            done[active, best_at] = True
            near = self.edges[ids[active, best_at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[np.broadcast_to(active[:, None], near.shape)[fresh], near[fresh]] = True
            new_far = np.where(fresh, self._squares(vectors[active], norms[active], near), np.inf)
            all_far = np.concatenate((far[active], new_far), axis=1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[active] = np.take_along_axis(all_far, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(fresh, near, -1)), axis=1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate((done[active], np.zeros(near.shape, bool)), axis=1), keep, 1)
        return np.where(np.isfinite(far), ids, -1), far

    def _prune(self, points: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """(b, degree) of the candidates (b, m; -1: none) of each point, chosen near but in many directions."""
        b, m = candidates.shape
        safe = np.where(candidates < 0, 0, candidates)
        # A repeated candidate or the point itself is none.
        order = np.argsort(safe, axis=1, kind="stable")
        ordered = np.take_along_axis(candidates, order, 1)
        again = np.zeros((b, m), bool)
        again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        repeated = np.zeros((b, m), bool)
        np.put_along_axis(repeated, order, again, 1)
        none = (candidates < 0) | repeated | (candidates == points[:, None])
        far = np.where(none, np.inf, self._squares(self.x[points], self.norms[points], safe))
        vectors = self.x[safe]
        between = np.maximum(
            self.norms[safe][:, :, None] + self.norms[safe][:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 0
        )
        chosen = np.full((b, self.degree), -1, np.int32)
        rows, alive, square = np.arange(b), far.copy(), relax * relax
        for slot in range(min(self.degree, m)):
            at = alive.argmin(1)
            there = np.isfinite(alive[rows, at])
            if not there.any():
                break
            chosen[there, slot] = candidates[rows[there], at[there]]
            alive[square * between[rows, at] <= far] = np.inf
            alive[rows, at] = np.inf
        return chosen

    def _improve(self, points: np.ndarray, beam: int, relax: float) -> None:
        found, _ = self.walk(self.x[points], beam)
        chosen = self._prune(points, np.concatenate((found, self.edges[points]), axis=1), relax)
        self.edges[points] = -1
        self.edges[points, : self.degree] = chosen
        # The edges back, grouped by the point they start from.
        to, back = chosen.ravel(), np.repeat(points, self.degree)
        ok = to >= 0
        to, back = to[ok], back[ok]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        heads, first, sizes = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(first, sizes)
        rows = np.repeat(np.arange(len(heads)), sizes)
        wide = np.full((len(heads), self.width + int(sizes.max(initial=0))), -1, np.int64)
        wide[:, : self.width] = self.edges[heads]
        known = (self.edges[to] == back[:, None]).any(1)
        wide[rows[~known], self.width + slot[~known]] = back[~known]
        packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        fits = packed.shape[1] <= self.width or None
        over = np.zeros(len(heads), bool) if fits else (packed[:, self.width] >= 0)
        self.edges[heads[~over]] = packed[~over, : self.width]
        for lo in range(0, int(over.sum()), BATCH):
            some = np.flatnonzero(over)[lo : lo + BATCH]
            new = self._prune(heads[some], packed[some], relax)
            self.edges[heads[some]] = -1
            self.edges[heads[some], : self.degree] = new


def nearest(rows: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every` the k nearest rows found, by Euclidean
    distance in double precision, among all rows with another vec_id; ties go to the smaller vec_id.

    Every row is in the graph of its shard; a shard holds vectors of like magnitude, and its graph is built once. Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part. Equal vectors are one point of the graph with all the ids that a result can need. Vectors of
    different lengths are not compared. A shard with at most `beam` points is searched whole, so results are complete
    where there are few rows. Extra columns are ignored; empty tables give no rows.
    """
    whole = usable(rows).filter(F.exists("v", lambda x: x != 0))
    queries = whole.filter(F.col("vec_id") % every == 0).distinct()

    def prepare(p: np.ndarray) -> tuple[np.ndarray, Graph | None]:
        return p, Graph(p) if len(p) > beam else None

    def match(prepared: tuple[np.ndarray, Graph | None], q: np.ndarray):
        p, graph = prepared
        if graph is None:
            at = np.broadcast_to(np.arange(len(p)), (len(q), len(p)))
        else:
            at = np.concatenate([graph.walk(graph.seen_from_centre(q[lo : lo + BATCH]), beam)[0] for lo in range(0, len(q), BATCH)])
        scores = np.stack([distances(p[a], v) for a, v in zip(at, q)])
        scores = np.where(at < 0, np.inf, scores)
        order = np.lexsort((np.where(at < 0, len(p), at), scores))[:, : k + 1]
        return np.take_along_axis(at, order, 1), np.take_along_axis(scores, order, 1)

    index = distinct_vectors(whole, k + 1)
    found = search(index, queries, k, shard_rows, shard_rows, prepare, match, "double", False, magnitude(F.col("v")))
    return best(found.distinct(), k, F.col("score"))
