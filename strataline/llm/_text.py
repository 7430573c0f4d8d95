"""Vectorised word and byte hashing over Arrow text columns.

A chunk is a run of rows whose bytes lie in one buffer; every function works on
a whole chunk at once, so that NumPy's per-call cost is shared by its rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed & _MASK)) | U64(1)


BYTE_VALUE = constants(256, 11)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
KEPT_POWERS = (1 << 20) + 4096
_powers = [np.ones(1, U64), np.ones(1, U64)]


def release() -> None:
    """Give memory that is free back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only in the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for later calls unless they are many."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for b in (BASE, BASE_INVERSE):
        a = np.full(max(n, KEPT_POWERS), b, U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    if n <= KEPT_POWERS:
        _powers[:] = out
    return out[0][:n], out[1][:n]


@dataclass
class Chunk:
    """Rows [first, last) of a batch: their bytes and where each row begins."""

    first: int
    last: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[Chunk]:
    """Cut a text column into chunks of about ``most`` bytes; null is empty; a longer row is a chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield Chunk(first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


@dataclass
class Words:
    """Words of a chunk: byte spans, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray
    inside: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)


def words(chunk: Chunk) -> Words:
    """Runs of bytes other than space and 0x09 to 0x0D; no word crosses a row's end."""
    inside = ~SPACE[chunk.buf]
    edge = np.zeros(len(inside) + 1, bool)
    edge[chunk.offs] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, chunk.offs), inside)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums; see span_hash."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUE[buf] * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of byte spans; they depend on the spans' bytes alone."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hash(word_hash: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Hashes of all runs of k words, across rows too (see gram_starts)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = constants(k, seed)
    out = word_hash[:n] * c[0]
    for j in range(1, k):
        out = out + word_hash[j : j + n] * c[j]
    return mix(out)


def gram_starts(offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the k-word runs that lie within a row, and the rows' bounds among them."""
    counts = np.maximum(np.diff(offs) - k + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(bounds[-1]) + np.repeat(offs[:-1] - bounds[:-1], counts), bounds


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, given the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return mix(hashes + mix(row.astype(U64) + U64(1)))
