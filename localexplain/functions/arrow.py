"""Arrow batches as NumPy blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from localexplain.functions.draws import NARROW

CELLS_PER_BLOCK = 1 << 20
NARROW_CELLS = 1 << 17  # up to draws.NARROW features, where many passes go over a block: it stays in the cache


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def matrix(column: pa.Array) -> np.ndarray:
    """A vector column of equal lengths as (rows, D)."""
    return numbers(column.flatten()).reshape(len(column), -1)


def vectors(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def blocks(first: np.ndarray, last: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, lo, hi) pieces of about CELLS_PER_BLOCK or NARROW_CELLS cells that cover samples first..last of every row.

    Rows with the same sample range share a piece, so small B does not mean small pieces.
    """
    samples = max(1, (NARROW_CELLS if d <= NARROW else CELLS_PER_BLOCK) // d)
    for lo, hi in sorted(set(zip(first.tolist(), last.tolist()))):
        rows = np.flatnonzero((first == lo) & (last == hi))
        together = max(1, samples // (hi - lo + 1))
        for at in range(0, len(rows), together):
            for start in range(lo, hi + 1, samples):
                yield rows[at : at + together], start, min(hi, start + samples - 1)
