"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on toxic and one on ordinary text. A
window is a word between its borders, or of a run longer than ``WINDOW`` 4-grams each
overlapping part of that length; how many bytes fewer it takes with the toxic
dictionary than with the ordinary one, as a share of its length, is its gain, and that of
a long run is its best window's. (Windows of raw text over several words tell toxic
documents hardly apart, see the README.)
A match costs Zstandard about three bytes, too many for a word of eight: windows are
therefore widened, each of their 4-grams standing as a 3-byte code, so a match saves
in proportion to the characters that agree. In a second view of the words, with its own
two dictionaries, the first ``ANCHOR`` codes stand for all of the word up to there: a toxic
stem may consist of parts that are ordinary elsewhere in words. A document's gains (the
largest, how many pass fixed marks, and how many of a hundred words do, as an ordinary
document may hold such a word by chance) are calibrated to a probability on rows that the
dictionaries haven't seen.

Toxic documents are mostly ordinary text, so the toxic dictionary is trained on the
words whose 4-grams are frequent in toxic documents, by distinct preceding word (copies
of a document count once), and rare in ordinary ones.

The fit uses at most ``SAMPLE`` labelled rows of each class, chosen by hash, and of a text
of more than ``SAMPLE_CHARS`` characters as many, in ``SAMPLE_SLICES`` slices spread evenly
over it; every text is scored whole.

Defined cases: null and empty texts and texts without words score what a document
without gain scores; repeated rows score alike; a null ``doc_id`` is never held out;
labels without a document or without a value are left out; where a class has no
labelled rows, all scores are 0 (or 1, if only toxic rows exist); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import Rows, SegmentCache, gather
from .store import bounded_batches, lean, tidy
from .textscan import ALNUM, U64, Words, chunks, mix, text_bytes

SAMPLE = 800
#: Characters of a text that the fit sees, and the slices of a longer one: some 50 MB in all at most.
SAMPLE_CHARS, SAMPLE_SLICES = 1 << 15, 8
GRAM = 4
CODE = 3
#: 4-grams from a word's begin that also stand for what is before them in the word.
ANCHOR = 8
#: 4-grams of a window.
WINDOW = 64
LEVEL = 3
ORDINARY_DICTIONARY, TOXIC_DICTIONARY = 1 << 16, 1 << 13
#: Windows given to a dictionary's training.
WINDOWS = 60_000
#: A toxic 4-gram stands behind so many different words at least, and is so many times (by view) as frequent as in ordinary text.
CONTEXTS, LIFT = 6, (12.0, 8.0)
MARKS = (0.2, 0.4)
THRESHOLD = 0.3
CHUNK = 1 << 21
CACHED = 250_000
#: Stands in both dictionaries and before each window, so that no window is stored raw.
LEAD = bytes(range(1, 33))
_LEAST = 3
#: Codings of a word, and numbers that describe a document.
VIEWS = 2
FEATURES = VIEWS * (1 + 2 * len(MARKS)) + 1


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Coded:
    """Words, or some of them, between spaces: 4-gram codes of all positions, and where each word's begin and end."""

    def __init__(self, words: Words, which: np.ndarray | None = None):
        s, e = (words.starts, words.ends) if which is None else (words.starts[which], words.ends[which])
        size = e - s
        self.begin = np.cumsum(size + 2) - size - 2
        text = np.full(int((size + 2).sum()) + GRAM, 32, np.uint8)
        text[gather(self.begin + 1, size)] = words.data[gather(s, size)]
        acc = np.zeros(len(text) - GRAM, np.uint64)
        for i in range(GRAM):
            acc = acc * U64(0x9E3779B97F4A7C15) + text[i : len(text) - GRAM + i]
        self.grams = mix(acc)
        self.counts = np.maximum(size + 2 - GRAM + 1, 0)

        # The first 4-grams stand for all of the word up to their end.
        self.anchored = self.grams.copy()
        for i in range(1, ANCHOR):
            at = self.begin[self.counts > i] + i
            self.anchored[at] = mix(self.anchored[at - 1] * U64(0x9E3779B97F4A7C15) + self.grams[at])

    def codes(self, view: int) -> bytes:
        return (self.grams, self.anchored)[view].view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()


@dataclass(frozen=True)
class Model:
    """Dictionaries by view: codes of 4-grams wherever they stand in a word, and of its first parts."""

    toxic: tuple[bytes, ...]
    ordinary: tuple[bytes, ...]
    weights: tuple[float, ...]


def _compressors(toxic: bytes, ordinary: bytes) -> tuple:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(ordinary), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    out = []
    for raw in (toxic, ordinary):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
    return tuple(out)


def window_starts(n: int) -> range | list[int]:
    """Where the windows of a run of ``n`` 4-grams begin: half a window apart, the last at its end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, WINDOW // 2), n - WINDOW]


@lru_cache(maxsize=2)
def gains(model: Model) -> SegmentCache:
    """Gain by word, of windows compressed once for each worker."""
    pairs = [_compressors(*p) for p in zip(model.toxic, model.ordinary, strict=True)]
    store = Rows(**{f"gain{v}": np.float32 for v in range(VIEWS)})

    def solve(words: Words, which: np.ndarray) -> None:
        coded = Coded(words, which)
        out = {}
        for v, (toxic, ordinary) in enumerate(pairs):
            raw = coded.codes(v)
            gain = np.full(len(which), -1.0, np.float32)
            for i in np.flatnonzero(coded.counts >= _LEAST).tolist():
                lo, n = int(coded.begin[i]), int(coded.counts[i])
                for at in window_starts(n):
                    size = min(WINDOW, n - at) * CODE
                    window = LEAD + raw[(lo + at) * CODE : (lo + at) * CODE + size]
                    gain[i] = max(gain[i], (len(ordinary(window)) - len(toxic(window))) / size)
            out[f"gain{v}"] = gain
        store.append(np.ones(len(which), np.int64), **out)

    return SegmentCache(CACHED, solve, store)


def features(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from row, to row, features) of chunks of a string column."""
    cache = gains(model)
    data, offsets = text_bytes(pc.utf8_lower(column))
    for lo, hi in chunks(offsets, CHUNK):
        part = offsets[lo : hi + 1]
        words = Words(data[part[0] : part[-1]], part - part[0], ALNUM)
        at = cache.resolve(words)
        out = np.zeros((hi - lo, FEATURES))
        some = np.flatnonzero(words.counts)
        if len(some):
            first, total = words.first[:-1][some], words.counts[some]
            for v in range(VIEWS):
                g = cache.stores[0].columns[f"gain{v}"][at]
                col = v * (1 + 2 * len(MARKS))
                out[some, col] = np.maximum(np.maximum.reduceat(g, first), 0)
                for mark in MARKS:
                    passed = np.add.reduceat((g > mark).astype(np.int64), first)
                    # How many, and how many of a hundred.
                    out[some, col + 1], out[some, col + 2] = np.log1p(passed), np.log1p(100 * passed / total)
                    col += 2
        out[:, -1] = np.log1p(words.counts) / 10
        yield lo, hi, out


def probability(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    w = np.array(weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, ...]:
    """Weights of a ridge logistic regression, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    try:
        raw = zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
    return raw + LEAD


def _windows(coded: Coded, which: np.ndarray, view: int) -> list[bytes]:
    raw = coded.codes(view)
    return [raw[int(b) * CODE : (int(b) + int(n)) * CODE] for b, n in zip(coded.begin[which], coded.counts[which], strict=True)]


def _fit_view(view: int, parts: list[Words], coded: list[Coded]) -> tuple[bytes, bytes]:
    """Toxic and ordinary dictionary of a view, from the words of ordinary and toxic texts."""
    found = []
    for words, c in zip(parts, coded, strict=True):
        owner = np.repeat(np.arange(len(c.counts)), c.counts)
        grams = (c.grams, c.anchored)[view][gather(c.begin, c.counts)]
        before = np.concatenate([[U64(0)], words.hashes[:-1]]) if len(words.hashes) else words.hashes
        # Each 4-gram counts once for each preceding word.
        pair, at = np.unique(mix(grams) ^ before[owner], return_index=True)
        found.append((owner, grams, np.unique(grams[at], return_counts=True), len(pair)))
    (_, _, (known, counts), ordinary_total), (owner, grams, (toxic_grams, toxic_counts), toxic_total) = found
    at = np.minimum(np.searchsorted(known, toxic_grams), max(0, len(known) - 1))
    ordinary_counts = np.where(known[at] == toxic_grams, counts[at], 0) if len(known) else np.zeros(len(toxic_grams))
    share = max(1, ordinary_total) / max(1, toxic_total)
    telling = np.sort(toxic_grams[(toxic_counts >= CONTEXTS) & (toxic_counts * share > LIFT[view] * (ordinary_counts + 0.5))])
    if not len(telling):
        telling = np.sort(toxic_grams)
    use = [c.counts >= _LEAST for c in coded]
    hits = np.bincount(owner[np.isin(grams, telling)], minlength=len(use[1]))
    windows = _windows(coded[1], np.flatnonzero(use[1] & (2 * hits >= np.minimum(coded[1].counts, 4)) & (hits >= 2)), view)
    pick = np.random.Generator(np.random.PCG64(7))
    take = lambda w: [w[i] for i in pick.permutation(len(w))[:WINDOWS]]
    toxic = take(windows)
    ordinary = np.flatnonzero(use[0])
    ordinary = ordinary[pick.permutation(len(ordinary))[:WINDOWS]]
    return _dictionary(TOXIC_DICTIONARY, toxic or [LEAD]), _dictionary(ORDINARY_DICTIONARY, _windows(coded[0], ordinary, view) or [LEAD])


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit dictionaries on two thirds of the rows, and the calibration on the others."""
    y = np.array(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model((LEAD,) * VIEWS, (LEAD,) * VIEWS, (30.0 if len(y) and y[0] else -30.0, *[0.0] * FEATURES))
    learn = np.arange(len(y)) % 3 != 2
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn[:] = True
    rest = ~learn if not learn.all() else learn
    column = pc.utf8_lower(pa.array(texts, pa.string()))
    parts = [Words(*text_bytes(column.filter(pa.array(learn & (y == kind)))), ALNUM) for kind in (0, 1)]
    coded = [Coded(words) for words in parts]
    dictionaries = [_fit_view(view, parts, coded) for view in range(VIEWS)]
    model = Model(*(tuple(d) for d in zip(*dictionaries, strict=True)), ())
    x = np.concatenate([f for _, _, f in features(column.filter(pa.array(rest)), model)])
    return Model(model.toxic, model.ordinary, _logistic(x, y[rest]))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most ``sample`` labelled rows of each class that aren't held out, by hash of the id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    usable = usable.withColumn("__h", F.xxhash64("__id"))
    ids = usable.filter("toxic = 1").orderBy("__h", "__id").limit(sample).union(usable.filter("toxic = 0").orderBy("__h", "__id").limit(sample))
    # At most 2 * sample rows of three numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).filter("text IS NOT NULL")
    size, part = F.length("text"), SAMPLE_CHARS // SAMPLE_SLICES
    at = lambda i: F.floor((size - part) * i / (SAMPLE_SLICES - 1)).cast("int") + 1
    slices = F.concat_ws(" ", *[F.substr(F.col("text"), at(i), F.lit(part)) for i in range(SAMPLE_SLICES)])
    return rows.select("__h", "__id", F.when(size <= SAMPLE_CHARS, F.col("text")).otherwise(slices).alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    # A doc_id that repeats could bring any number of rows.
    rows = sample_rows(docs, labels, sample).orderBy("__h", "__id").limit(2 * sample).collect()
    model = train([r.text for r in rows], [r.toxic for r in rows])
    tidy()
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            for lo, hi, x in features(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, model):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(probability(x, model.weights))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lean(_scorer(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that score ``THRESHOLD`` or more; columns unchanged."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(names.index("text"))
            keep = np.concatenate([probability(x, model.weights) < THRESHOLD for _, _, x in features(text, model)]) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(lean(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
