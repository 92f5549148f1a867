"""Texts cut into segments that a tokenizer treats apart, and a cache by segment.

Tokenizing a text equals tokenizing its segments one after another, so each distinct
segment is worked out once per worker and looked up for all its other occurrences.
"""

from __future__ import annotations

import numpy as np

from .textscan import U64, hash_pieces

SPACE, NEWLINE = 32, 10


class Segments:
    """Segments of several documents; they cover all bytes. ``cut`` marks where one begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cut: np.ndarray):
        if len(data):
            cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        self.data = data
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], len(data)) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.hashes = hash_pieces(data, self.starts, self.ends)

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[s:e].decode() for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def cut_before_words(data: np.ndarray) -> np.ndarray:
    """Before a single space, and on both sides of a single newline, between two characters
    that surely aren't white space: ASCII graphs and U+00C0 to U+00FF. No pre-token of a
    byte-level tokenizer spans such a place."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        graph = (data > 32) & (data < 127)
        latin = data == 0xC3
        ends = graph.copy()
        ends[1:] |= latin[:-1]
        between = ends[:-2] & (graph | latin)[2:]
        line = (data[1:-1] == NEWLINE) & between
        cut[1:-2] = ((data[1:-1] == SPACE) & between) | line
        cut[2:-1] |= line
    return cut[:-1]


def cut_pairs(data: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Between two bytes that stand side by side in no piece of a vocabulary (``pairs`` [256, 256]), except
    within a character. No piece spans such a place."""
    cut = np.zeros(len(data), bool)
    if len(data):
        cut[1:] = ~pairs[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
    return cut


class HashIndex:
    """Open-addressing table of 64-bit hashes to 0, 1, 2, ...; all operations vectorised."""

    def __init__(self, most: int):
        self.most = most
        self.bits = max(4, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def release(self) -> None:
        """Empty, without the table's memory; ``clear`` makes it usable again."""
        self.keys, self.values, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of ``h`` (none is 0); -1 where absent."""
        out = np.full(len(h), -1, np.int32)
        slot, live, want = self._slots(h), np.arange(len(h)), h
        mask = len(self.keys) - 1
        while len(live):
            there = self.keys[slot]
            hit = there == want
            out[live[hit]] = self.values[slot[hit]]
            go = ~hit & (there != 0)
            live, slot, want = live[go], (slot[go] + 1) & mask, want[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct new hashes get the next values in order."""
        value = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        slot, mask = self._slots(h), len(self.keys) - 1
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.values[slot[won]] = value[won]
            h, value, slot = h[~won], value[~won], (slot[~won] + 1) & mask


class Rows:
    """Growing arrays of several columns, with rows of varying length."""

    def __init__(self, **kinds):
        self.kinds = kinds
        self.clear()

    def clear(self) -> None:
        self.used, self.count = 0, 0
        self.columns = {k: np.empty(1024, t) for k, t in self.kinds.items()}
        self.begin = np.zeros(1024, np.int64)

    def append(self, sizes: np.ndarray, **columns) -> None:
        total = int(sizes.sum())
        for k, v in columns.items():
            if self.used + total > len(self.columns[k]):
                self.columns[k] = np.concatenate([self.columns[k][: self.used], np.empty(max(total, self.used // 4), self.kinds[k])])
            self.columns[k][self.used : self.used + total] = v
        if self.count + len(sizes) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin[: self.count + 1], np.zeros(max(len(sizes), self.count // 4) + 1, np.int64)])
        self.begin[self.count + 1 : self.count + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.count += len(sizes)
        self.used += total


def gather(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``begin[i] ... begin[i] + sizes[i] - 1`` for all i, one after another."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(begin - first, sizes)


_CURRENT: list = []


class SegmentCache:
    """Segment -> its number in ``stores``, to which ``solve(segments, which)`` appends those first seen.

    Beyond ``most`` segments the cache starts anew. A worker keeps one cache: those of an
    earlier step are emptied when another is used.
    """

    def __init__(self, most: int, solve, *stores: Rows):
        self.index, self.solve, self.stores = HashIndex(most), solve, stores

    def clear(self) -> None:
        self.index.release()
        for rows in self.stores:
            rows.clear()

    def resolve(self, seg: Segments) -> np.ndarray:
        """Number of each segment."""
        if not _CURRENT or _CURRENT[0] is not self:
            for other in _CURRENT:
                other.clear()
            _CURRENT[:] = [self]
            self.index.clear()
        h = seg.hashes | U64(1)
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            if self.index.size + len(fresh) > self.index.most:
                self.clear()
                self.index.clear()
                missing = np.arange(len(h))
                fresh, first = np.unique(h, return_index=True)
                if len(fresh) > self.index.most:
                    self.index = HashIndex(2 * len(fresh))
            self.solve(seg, missing[first])
            self.index.add(fresh)
            at[missing] = self.index.find(h[missing])
        return at
