"""Vectorised passes over the UTF-8 bytes of Arrow text columns.

Every pass works on whole texts. Batches are cut between texts into chunks of about
``CHUNK_BYTES``, so a task's memory follows its longest text and not its batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """One 64-bit value per byte; A-Z share the values of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    return values


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of all words of a chunk, from one running sum over its bytes."""

    def __init__(self, in_word: np.ndarray):
        self.in_word = in_word
        self.values = byte_values()
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, bounds: np.ndarray):
        """Starts and ends of words, their hashes, and the first word of every text.

        ``bounds`` holds the start of each text and the end of the last; no word crosses it.
        """
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        if len(self._up) <= n:
            self._up = powers(_BASE, 2 * n + 1)
            self._down = powers(_BASE_INVERSE, 2 * n + 1)
        inside = self.in_word[data]
        edge = np.zeros(n + 1, bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[0] = edge[n] = True
        edge[bounds] = True
        cuts = np.flatnonzero(edge)
        keep = inside[cuts[:-1]]
        starts, ends = cuts[:-1][keep], cuts[1:][keep]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self._up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self._down[starts])
        return starts, ends, hashes, np.searchsorted(starts, bounds)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and their bounds; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw[:0], bounds - (bounds[0] if len(bounds) else 0)


def chunks(column: pa.Array):
    """(first row, last row, bytes, bounds) of runs of texts of about ``CHUNK_BYTES``."""
    data, bounds = texts(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        last = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1
        last = min(rows, max(row + 1, last))
        yield row, last, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
