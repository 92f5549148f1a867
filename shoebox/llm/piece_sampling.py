"""Sampled segmentations by forward filtering and backward sampling; lossless decoding.

Forward: the log of the summed weight of all segmentations up to each position.
Backward: from the end, a piece is drawn in proportion to what the segmentations
through it weigh. A piece's weight is its probability (Zipf's law over the
vocabulary's order) to the power ``SMOOTH``. No piece spans the border of a segment,
so segments are filtered once, and sampled at each of their places.

Random numbers come from the row key, the segment's number in the text and the step,
and are compared as integers: a row is segmented alike in every run, batch and task.

Defined cases: a null or empty text has no pieces; rows that repeat a key and a text
are segmented alike; a null key counts as 0; the mark U+2581 of a text is kept by its
bytes, as is any character that no piece covers; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import Edges, Vocabulary, model_path, utf8_sizes, vocabulary, with_mark
from .segments import Rows, SegmentCache, Segments, cut_pairs, gather
from .store import bounded_batches, lean
from .textscan import U64, chunks, mix, text_bytes

CHUNK = 1 << 19
#: Segments cached by a worker; some 35 MB.
CACHED = 100_000
SMOOTH = 0.5
SEED = 20240229
BITS = 24


def forward(v: Vocabulary, edges: Edges, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """(cumulative share of each edge among those of its end, in units of 2**-BITS; first edge of each end)."""
    alpha = np.zeros(edges.length + 1)
    known = edges.piece >= 0
    weight = smooth * np.where(known, v.log_p[np.maximum(edges.piece, 0)], v.log_p_unknown)
    upto = np.empty(len(weight))
    for e, first in edges.levels():
        total = alpha[edges.start[e]] + weight[e]
        size = np.diff(np.append(first, len(e)))
        top = np.maximum.reduceat(total, first)
        part = np.exp(total - np.repeat(top, size))
        run = np.cumsum(part)
        run -= np.repeat(run[first] - part[first], size)
        whole = run[first + size - 1]
        alpha[edges.end[e[first]]] = top + np.log(whole)
        upto[e] = run / np.repeat(whole, size)
    share = np.maximum(1, np.rint(upto * (1 << BITS)).astype(np.int64))
    first = np.flatnonzero(np.diff(edges.end, prepend=-1))
    share[np.append(first[1:], len(share)) - 1] = 1 << BITS
    return share.astype(np.int32), first


@lru_cache(maxsize=2)
def sampler(path: str, smooth: float) -> SegmentCache:
    """Stores: edges (share, piece), and for each character the edges that end behind it."""
    v = vocabulary(path)
    store, ends = Rows(share=np.int32, piece=np.int32), Rows(edge=np.int64)

    def solve(seg: Segments, which: np.ndarray) -> None:
        edges = Edges(v, seg.strings(which))
        share, first = forward(v, edges, smooth)
        owner = np.searchsorted(edges.base, edges.end - 1, "right") - 1
        before = store.used
        store.append(np.bincount(owner, minlength=len(which)), share=share, piece=edges.piece)
        ends.append(edges.sizes, edge=before + first)

    return SegmentCache(CACHED, solve, store, ends)


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, path: str, smooth: float = SMOOTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per document) of texts that begin with their mark, see ``with_mark``."""
    v, cache = vocabulary(path), sampler(path, smooth)
    seg = Segments(data, offsets, cut_pairs(data, v.pairs))
    at = cache.resolve(seg)
    store, ends = cache.stores
    share, pieces, edge = store.columns["share"], store.columns["piece"], ends.columns["edge"]
    n = np.diff(seg.first)
    number = np.arange(len(at)) - np.repeat(seg.first[:-1], n)
    stream = mix(np.repeat(mix(keys.astype(np.int64).view(np.uint64) + U64(seed)), n) + number.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    live = np.arange(len(at), dtype=np.int32)
    left = (ends.begin[at + 1] - ends.begin[at]).astype(np.int32)
    node = ends.begin[at + 1] - 1
    taken, steps = np.zeros(len(at), np.int32), []
    lengths = np.append(v.lengths, 1).astype(np.int32)
    while len(live):
        stream = mix(stream + U64(0xD1B54A32D192ED03))
        u = (stream >> U64(64 - BITS)).astype(np.int32)
        e = edge[node]
        more = np.flatnonzero(share[e] <= u)
        while len(more):
            e[more] += 1
            more = more[share[e[more]] <= u[more]]
        piece = pieces[e]
        steps.append((live, piece))
        taken[live] += 1
        length = lengths[np.where(piece < 0, v.size, piece)]
        left, node = left - length, node - length
        go = np.flatnonzero(left > 0)
        live, left, node, stream = live[go], left[go], node[go], stream[go]
    behind = np.cumsum(taken.astype(np.int64))
    out = np.empty(int(behind[-1]) if len(behind) else 0, np.int32)
    for step, (who, piece) in enumerate(steps):
        out[behind[who] - 1 - step] = piece
    counts = np.diff(np.concatenate([[0], behind])[seg.first])
    return _spell(v, out, counts)


def _spell(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters become the ids of their bytes."""
    unknown = np.flatnonzero(ids < 0)
    if not len(unknown):
        return ids, counts
    codes = -1 - ids[unknown].astype(np.int64)
    size = np.ones(len(ids), np.int64)
    size[unknown] = utf8_sizes(codes)
    begin = np.cumsum(size) - size
    out = np.repeat(ids, size)
    raw = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    out[gather(begin[unknown], size[unknown])] = v.byte_ids[raw]
    total = np.concatenate([[0], np.cumsum(size)])
    return out, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def decode(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, marks dropped."""
    v = vocabulary(path)
    begin = v.blob_begin[ids]
    size = v.blob_begin[ids + 1] - begin
    data = v.blob[gather(begin, size)]
    offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    begun = offsets[:-1] < offsets[1:]
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][begun]] = False
    return data[keep], offsets - np.concatenate([[0], np.cumsum(begun)])


ENCODED = "doc_id long, n_pieces long, ids array<int>"
DIGEST = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, smooth: float, seed: int):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in chunks(offsets, CHUNK):
            part = offsets[lo : hi + 1]
            plain, begin = data[part[0] : part[-1]], part - part[0]
            ids, counts = sample(*with_mark(plain, begin), keys[lo:hi], path, smooth, seed)
            yield b.column(0).slice(lo, hi - lo), plain, begin, ids, counts


def _encode(path: str, smooth: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, ids, counts in _encoded(batches, path, smooth, seed):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([key, pa.array(counts, pa.int64()), lists], names=["doc_id", "n_pieces", "ids"])

    return run


def _digest(path: str, smooth: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, plain, begin, ids, counts in _encoded(batches, path, smooth, seed):
            back, ends = decode(ids, counts, path)
            raw, at = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            if np.array_equal(ends, begin) and np.array_equal(back, plain):
                same = np.ones(len(counts), bool)
            else:
                same = np.array([back[a:b].tobytes() == plain[c:d].tobytes() for a, b, c, d in zip(ends[:-1], ends[1:], begin[:-1], begin[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([key, pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", smooth: float = SMOOTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids of a sampled segmentation per document."""
    return _rows(docs, id_col, text_col).mapInArrow(lean(_encode(path, smooth, seed)), ENCODED)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = decode(ids, counts, path)
            text = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digest of the sampled ids per document, and whether decoding them gave the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _rows(docs, "doc_id", "text").mapInArrow(lean(_digest(path or model_path(), SMOOTH, SEED)), DIGEST)
