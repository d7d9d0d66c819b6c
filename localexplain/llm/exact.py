"""Inner products of whole numbers without rounding, whatever their size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def whole(v: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as a double, exact for a factor that is a power of two."""
    # From 2^44 on, 256 * x is a whole number; floor() would cut it off at the largest long.
    return F.transform(v, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * factor).cast("double")).otherwise(x * factor))


def bounded(q: np.ndarray, p: np.ndarray) -> bool:
    """Whether no sum of products of these vectors leaves 62 bits."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1]) < 2**62


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """q @ p.T of whole doubles, exact: as int64 where no partial sum can leave 62 bits, else as Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ p.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    integers = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return integers(q) @ integers(p).T


def as_long(scores) -> list[int]:
    """Scores as Python integers; one that no long can hold is an error rather than a wrong result."""
    out = [int(s) for s in scores]
    if out and not (LONG_MIN <= min(out) and max(out) <= LONG_MAX):
        raise OverflowError("an inner product is beyond the range of a long")
    return out
