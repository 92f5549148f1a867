"""Vectorised word scanning over Arrow string columns.

Texts stay in Arrow's byte buffer; numpy finds words and hashes them without a
Python object for each. Used wherever every word of every text is visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z, all above ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_SPAN = 64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, (_SPAN, 256), dtype=np.uint64)
#: Bytes hashed at once; bounds the numpy temporaries.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hash of ``data[s:e]`` for each pair; pairs ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    lo, n = 0, len(starts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK, "left")))
        s, e = starts[lo:hi], ends[lo:hi]
        size = e - s
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        value = data[at + np.repeat(s, size)]
        v = _TABLE[at & (_SPAN - 1), value]
        if len(at) and int(size.max()) > _SPAN:
            far = np.flatnonzero(at >= _SPAN)
            v[far] *= mix((at[far] >> 6).astype(np.uint64)) | U64(1)
        total = np.add.reduceat(v, first) if len(v) else np.zeros(hi - lo, np.uint64)
        out[lo:hi] = mix(total + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        lo = hi
    return out


class Words:
    """Words of several documents: byte starts and ends, hashes, and counts by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        inside = member[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words before each document, and after the last.
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.counts = np.diff(self.first)
        self.hashes = hash_pieces(self.data, self.starts, self.ends)
