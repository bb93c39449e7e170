"""Numpy views of Arrow text columns, and vectorised hashing over whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that are worked on at once; a longer text is one piece of its own.
PIECE = 1 << 20


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back when a task ends: workers go on to other stages."""

    @wraps(run)
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return outer


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, limit: int = PIECE, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of at most so many rows with about limit bytes."""
    data, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


#: Powers that a worker keeps; longer texts compute their own.
_KEPT_BITS = 20
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, at least, of a base and of its inverse."""
    if base in _kept and n < len(_kept[base][0]):
        return _kept[base]
    bits = max(16, n.bit_length())
    b, one = _BASES[base], np.ones(1, U)
    both = tuple(np.concatenate([one, np.cumprod(np.full(1 << bits, x, U))]) for x in (b, pow(b, -1, 1 << 64)))
    if bits <= _KEPT_BITS:
        _kept[base] = both
    return both


class Rolling:
    """Hashes of any byte ranges of a piece, from one running sum modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = 0):
        self.up, self.down = _powers(base, len(data))
        term = (data.astype(U) + U(1)) * self.up[: len(data)]
        self.total = np.concatenate([np.zeros(1, U), np.cumsum(term, dtype=U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U))

    def every(self, length: int) -> np.ndarray:
        """The hash of each range of length bytes."""
        n = len(self.total) - length
        if n <= 0:
            return np.zeros(0, U)
        x = self.total[length:] - self.total[:-length]
        x *= self.down[:n]
        return mix(x)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of bytes outside 0x20 and 0x09-0x0D; no run crosses texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return _LOWER[data]
