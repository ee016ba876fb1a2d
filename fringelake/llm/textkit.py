"""Vectorised text kernels on Arrow string columns.

A column is viewed as one byte array plus offsets; words are found with byte
class tables and hashed eight bytes at a time, with a mixing step after each, so
there is no Python loop over words. Sequences of words are hashed with prefix
sums of a polynomial over the words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes as they are, and with A-Z as a-z.
EXACT = np.arange(256, dtype=np.uint8)
FOLDED = EXACT.copy()
FOLDED[65:91] += 32

#: The six ASCII white-space bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside letters, digits and multi-byte characters.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, U64), np.empty(n, U64)
    with np.errstate(over="ignore"):
        for out, base in ((up, _BASE), (down, _INV)):
            out[0], have, step = 1, 1, U64(base)
            while have < n:
                more = min(have, n - have)
                out[have : have + more] = out[:more] * step
                step *= step
                have += more
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i below n at least."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Sums:
    """Prefix sums of a symbol array; hash of any range in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.up, down = powers(len(symbols) + 1)
        self.p = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * down[: len(symbols)], out=self.p[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.p[end] - self.p[start]) * self.up[start] + (end - start).astype(U64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; `breaks` marks the bytes that part them."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: Longer words are hashed one by one.
LONG = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U64)


class Bytes:
    """Text bytes, by a table of 256 values, to hash ranges of."""

    def __init__(self, data: np.ndarray, table: np.ndarray = EXACT):
        self.data = data if table is EXACT else table[data]
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self._eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix((self._eight[start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(0x9E3779B97F4A7C15)))
        more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            left = size[more] - done
            h[more] = mix((h[more] * U64(0xC2B2AE3D27D4EB4F) + U64(done)) ^ (self._eight[start[more] + done] & _KEEP[np.minimum(left, 8)]))
            done += 8
            more = more[left > 8]
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(self.data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    return Bytes(data, table).hash(starts, ends)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def passing(h: np.ndarray, bits: int, known: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap (see session.bitmap) lets pass."""
    place = h & U64((1 << bits) - 1)
    return np.flatnonzero((known[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1)
