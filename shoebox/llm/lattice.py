"""Lattice of a piece vocabulary over many segments at once.

Aho-Corasick enumerates the vocabulary's matches; numpy then works on all segments
together, level by level of the end position. A character that no piece of length 1
covers gets an edge of its own, which stands for its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .segments import SPACE

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Fixed value: what an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces of a model, with an automaton over those that stand for text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.size = n
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in np.flatnonzero(self.normal).tolist():
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.worst = float(self.scores[self.normal].min()) - UNKNOWN_PENALTY
        #: Zipf's law over the order in which the pieces were merged: log probabilities.
        rank = np.full(n, np.inf)
        order = np.flatnonzero(self.normal)[np.argsort(-self.scores[self.normal], kind="stable")]
        rank[order] = np.arange(1, len(order) + 1)
        self.log_p = -np.log(rank) - np.log(np.sum(1.0 / rank[order]))
        self.log_p_unknown = float(self.log_p[order].min()) - UNKNOWN_PENALTY
        inverse = {int(i): b for b, i in enumerate(self.byte_ids)}
        raw = [bytes([inverse[i]]) if i in inverse else x.replace(MARK, " ").encode() if ok else b"" for i, (x, ok) in enumerate(zip(self.pieces, self.normal, strict=True))]
        #: Bytes that stand side by side in some piece, marks as spaces.
        self.pairs = np.zeros((256, 256), bool)
        for x, ok in zip(raw, self.normal, strict=True):
            if ok:
                b = np.frombuffer(x, np.uint8)
                self.pairs[b[:-1], b[1:]] = True
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.blob_begin = np.concatenate([[0], np.cumsum([len(x) for x in raw])])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Edges:
    """Edges of all segments, sorted by (segment, end, start): piece (or -1 - code point), start and end
    as positions in the segments' joined text, and level (end within the segment)."""

    def __init__(self, v: Vocabulary, texts: list[str]):
        # Spaces stand as the mark; a mark of the text itself is no piece's, and goes by its bytes.
        plain = "\n".join(texts)
        joined = plain.replace(MARK, "￾").replace(" ", MARK)
        flat = np.fromiter(chain.from_iterable(v.automaton.iter(joined)), np.int64)
        end, piece = flat[::2] + 1, flat[1::2]
        start = end - v.lengths[piece]
        self.sizes = np.array([len(x) for x in texts], np.int64)
        #: Where each segment begins in the joined text.
        self.base = np.cumsum(self.sizes + 1) - self.sizes - 1
        inside = np.ones(len(joined), bool)
        inside[self.base[1:] - 1] = False
        newline = np.flatnonzero(self.sizes == 1)
        inside[self.base[newline]] = True
        covered = np.zeros(len(joined), bool)
        covered[start[end - start == 1]] = True
        lonely = np.flatnonzero(inside & ~covered)
        if len(lonely):
            codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32)[lonely].astype(np.int64)
            start, end, piece = np.concatenate([start, lonely]), np.concatenate([end, lonely + 1]), np.concatenate([piece, -1 - codes])
        order = np.argsort(end, kind="stable") if len(lonely) else slice(None)
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        owner = np.searchsorted(self.base, self.end - 1, "right") - 1
        self.level = self.end - self.base[owner]
        self.length = len(joined)

    def levels(self):
        """(edges, where each end's edges begin among them) of level 1, 2, ..."""
        order = np.argsort(self.level, kind="stable")
        cuts = np.flatnonzero(np.diff(self.level[order], prepend=0))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            e = order[lo:hi]
            yield e, np.flatnonzero(np.diff(self.end[e], prepend=-1))


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def with_mark(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    begun = offsets[:-1] < offsets[1:]
    moved = offsets + np.concatenate([[0], np.cumsum(begun)])
    return np.insert(data, offsets[:-1][begun], SPACE), moved


def marks_as_spaces(column: pa.Array) -> pa.Array:
    return pc.replace_substring(column, MARK, " ")
