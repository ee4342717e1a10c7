"""Text columns of Arrow batches as arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_CODE = 0x110000


def blocks(column: pa.Array, most_chars: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, code points, offsets) for runs of rows of about ``most_chars`` characters.

    Offsets has one entry more than rows; null rows are empty. A single longer text is a block of its own, so that texts
    of any length go through whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most_chars, "right")) - 1)
        piece = data[ends[row] : ends[stop]]
        starts = (piece & 0xC0) != 0x80  # bytes that begin a character
        counted = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(starts, out=counted[1:])
        points = np.frombuffer(piece.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield row, stop, points, counted[ends[row : stop + 1] - ends[row]]
        row = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit scramble of each value (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class CodeTable:
    """Properties of code points, worked out when one is first seen: ``fill`` gets the new ones and writes the arrays."""

    def __init__(self, **kinds: type) -> None:
        self.known = np.zeros(MAX_CODE, bool)
        for name, kind in kinds.items():
            setattr(self, name, np.zeros(MAX_CODE, kind))

    def learn(self, points: np.ndarray) -> None:
        new = ~self.known[points]
        if new.any():
            for code in np.unique(points[new]).tolist():
                self.fill(code)
                self.known[code] = True

    def fill(self, code: int) -> None:
        raise NotImplementedError
