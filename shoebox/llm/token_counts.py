"""Token counts by count-only Viterbi over a unigram vocabulary.

The best segmentation has the highest sum of scores; only its score and number of
pieces are carried, never the pieces. Rules of the tokenizer: of segmentations with
equal scores at a place, the one whose last piece is longest wins; an unknown
character costs 10 more than the worst piece and counts its UTF-8 bytes.

Sums are exact (scores are small integers in double precision), so a text's best
segmentation is that of its segments, each worked out once.

Defined cases: a null or empty text has 0 tokens and score 0; repeated rows are
counted each; a null ``doc_id`` is kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import Edges, Vocabulary, marks_as_spaces, model_path, utf8_sizes, vocabulary, with_mark
from .segments import Rows, SegmentCache, Segments, cut_pairs
from .store import bounded_batches, lean
from .textscan import chunks, text_bytes

CHUNK = 1 << 22
#: Segments cached by a worker; some 90 MB.
CACHED = 1_500_000


def viterbi(v: Vocabulary, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """(best score, pieces) of each segment."""
    best, count = np.zeros(edges.length + 1), np.zeros(edges.length + 1, np.int64)
    known = edges.piece >= 0
    score = np.where(known, v.scores[np.maximum(edges.piece, 0)], v.worst)
    worth = np.where(known, 1, utf8_sizes(-1 - edges.piece))
    # Positions between segments are starting points with score 0, as they are left untouched.
    for e, first in edges.levels():
        total = best[edges.start[e]] + score[e]
        top = np.maximum.reduceat(total, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
        won = np.minimum.reduceat(np.where(total == top[group], np.arange(len(e)), len(e)), first)
        end, chosen = edges.end[e[first]], e[won]
        best[end], count[end] = top, count[edges.start[chosen]] + worth[chosen]
    ends = edges.base + edges.sizes
    return best[ends], count[ends]


@lru_cache(maxsize=2)
def counter(path: str) -> SegmentCache:
    v, store = vocabulary(path), Rows(score=np.float64, count=np.int64)

    def solve(seg: Segments, which: np.ndarray) -> None:
        score, count = viterbi(v, Edges(v, seg.strings(which)))
        store.append(np.ones(len(which), np.int64), score=score, count=count)

    return SegmentCache(CACHED, solve, store)


def count_tokens(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, pieces, score) of chunks of a string column."""
    cache, pairs = counter(path), vocabulary(path).pairs
    data, offsets = text_bytes(marks_as_spaces(column))
    for lo, hi in chunks(offsets, CHUNK):
        part = offsets[lo : hi + 1]
        text, begin = with_mark(data[part[0] : part[-1]], part - part[0])
        seg = Segments(text, begin, cut_pairs(text, pairs))
        at = cache.resolve(seg)
        columns = cache.stores[0].columns
        count = np.concatenate([[0], np.cumsum(columns["count"][at])])
        score = np.concatenate([[0.0], np.cumsum(columns["score"][at])])
        yield lo, hi, np.diff(count[seg.first]), np.diff(score[seg.first])


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, n, score in count_tokens(b.column(1), path):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation per document."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_count(path)), "doc_id long, n_tokens long, score double")


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or model_path())
