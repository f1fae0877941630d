"""Vectorised text kernels shared by the operators: words, hashes, blocks of an Arrow batch.

Everything works on UTF-8 bytes with numpy.  A batch is cut into blocks of about a megabyte, so memory
stays bounded by the block (or by one document, if that is longer); texts are always processed whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Separators of words: space and 0x09 to 0x0D. All are single bytes in UTF-8.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE_LOWER = _BYTE[LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_P = _P if _P % 8 in (3, 5) else _P + 2
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers.get("p", ())) < n:
        size = max(n, BLOCK + 1)
        for k, base in (("p", _P), ("i", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def trim() -> None:
    """Give freed memory back to the system at the end of a task, as workers stay for the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `size` bytes: (first row, end row, bytes, offsets)."""
    buf, off = column_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n+1 values)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = solid[off[:-1][full]]
    last[off[1:][full] - 1] = solid[off[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER, size: int = BLOCK) -> np.ndarray:
    """64-bit hashes of byte spans that begin and end in ascending order (by default A-Z count as a-z)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        p, inv = powers(b - a + 1)
        acc = np.empty(b - a + 1, np.uint64)
        acc[0] = 0
        np.cumsum(table[buf[a:b]] * p[: b - a], out=acc[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block, and the index of each document's first word."""
    starts, ends, at = word_bounds(buf, off)
    return span_hashes(buf, starts, ends), at


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; by sorting, which is faster than numpy's hashing for such keys."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and for each element the place of its own."""
    order = np.argsort(x)
    y = x[order]
    new = np.append(True, y[1:] != y[:-1]) if len(y) else np.zeros(0, bool)
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return y[new], place


def owners(at: np.ndarray) -> np.ndarray:
    """For offsets at (n+1 values): which document each element belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def segment_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x over the ranges at[i]:at[i+1]; 0 for empty ones."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[at[1:]] - total[at[:-1]]


class HashTable:
    """A read-only open-addressing table from 64-bit hashes to int32 places, made for vectorised lookups.

    Values are the places of the given distinct keys; -1 stands for absent.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1))))
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (size - 1)

    def find(self, query: np.ndarray) -> np.ndarray:
        out = np.full(len(query), -1, np.int32)
        if not len(self.keys) or not len(query):
            return out
        mask, at = len(self.slot) - 1, (query >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot[at]
        same = (got >= 0) & (self.keys[got] == query)
        out[same] = got[same]
        todo = np.flatnonzero((got >= 0) & ~same)
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            got = self.slot[at]
            same = (got >= 0) & (self.keys[got] == query[todo])
            out[todo[same]] = got[same]
            more = (got >= 0) & ~same
            todo, at = todo[more], at[more]
        return out
