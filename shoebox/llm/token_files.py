"""Token-id files with a minimal perfect hash index.

Texts are range-partitioned by key, encoded, and written as raw little-endian ids in
ascending key order, in shards of bounded size. Behind the ids stand the documents'
offsets, their keys, and an index: a minimal perfect hash (levels of bit arrays with a
running count each ``SAMPLED`` words) maps a key to its slot, and the slot holds a
fingerprint and the number of the key's first document.

The manifest holds each shard's smallest and largest key. :func:`lookup` picks the shard by
them, computes one slot from a few words of the index, compares the fingerprint and the key
itself, and reads one slice: a constant number of reads of a few bytes, however large the
shard.

Only shards named in the manifest are read, so retried attempts do no harm.

Defined cases: a null or empty text is the end id alone; null keys come first, in a
shard's head, and aren't in the index; rows that repeat a key stand next to each
other, by their texts' hash, possibly in several shards, and each shard's index leads to
its first and their number; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import SPACE, Rows, SegmentCache, Segments, cut_before_words, gather
from .store import bounded_batches, lean, materialize, open_read, open_write, scratch, task_tag
from .textscan import U64, chunks, mix, text_bytes

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CHUNK = 1 << 22
#: Segments cached by a worker; some 80 MB.
CACHED = 1_500_000
#: Segments that are encoded as lines of one text.
BLOCK = 2_000
#: Bytes that are or may begin white space: controls, space, and leads of U+0085, U+00A0, U+1680, U+2000 and on, U+3000.
ODD = np.zeros(256, bool)
ODD[:33] = ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
GAMMA = 2.0
#: Words of a level between running counts.
SAMPLED = 8
#: A shard is closed beyond so many bytes of ids, or documents.
SHARD_BYTES, SHARD_DOCS = 1 << 28, 1 << 22
MAGIC = b"TOKIDX02"
_HEAD = struct.Struct("<8sIIQQQQ")  # magic, bytes per id, levels, documents, null keys, distinct keys, ids


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[SegmentCache, np.dtype]:
    """Cache of the tokenizer's ids by segment; one for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    line = tokenizer.encode("\n", add_special_tokens=False).ids

    def each(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), kind, int(sizes.sum()))

    def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``each``, for segments without inner white space: lines of one text, told apart by the newline's id."""
        blocks = [texts[i : i + BLOCK] for i in range(0, len(texts), BLOCK)]
        sizes, ids = [], []
        for block, x in zip(blocks, tokenizer.encode_batch_fast(["\n".join(b) for b in blocks], add_special_tokens=False), strict=True):
            got = np.array(x.ids, np.int64)
            ends = np.append(np.flatnonzero(got == line[0]), len(got))
            if len(line) != 1 or len(ends) != len(block):
                more = each(block)
            else:
                more = np.diff(ends, prepend=-1) - 1, got[got != line[0]].astype(kind)
            sizes.append(more[0])
            ids.append(more[1])
        return np.concatenate(sizes), np.concatenate(ids)

    store = Rows(ids=kind)

    def solve(seg: Segments, which: np.ndarray) -> None:
        odd = np.concatenate([[0], np.cumsum(ODD[seg.data])])
        first = seg.data[seg.starts[which]] == SPACE
        plain = odd[seg.ends[which]] - odd[seg.starts[which]] == first
        sizes, begin, parts, used = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), [], 0
        for some, f in ((plain, joined), (~plain, each)):
            if some.any():
                n, ids = f(seg.strings(which[some]))
                sizes[some], begin[some] = n, used + np.cumsum(n) - n
                parts.append(ids)
                used += len(ids)
        store.append(sizes, ids=np.concatenate(parts)[gather(begin, sizes)])

    return SegmentCache(CACHED, solve, store), kind


def encode(data: np.ndarray, offsets: np.ndarray, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, each with its end id; ids per document)."""
    cache, kind = encoder(path)
    seg = Segments(data, offsets, cut_before_words(data))
    at = cache.resolve(seg)
    store = cache.stores[0]
    begin = store.begin[at]
    sizes = store.begin[at + 1] - begin
    before = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(before[seg.first])
    ids = store.columns["ids"][gather(begin, sizes)]
    out = np.full(len(ids) + len(counts), end_id, kind)
    mask = np.ones(len(out), bool)
    mask[np.cumsum(counts + 1) - 1] = False
    out[mask] = ids
    return out, counts + 1


class PerfectHash:
    """Distinct 64-bit keys -> 0 ... n-1 without storing them."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            count = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(count) - count)
            total += int(count.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % U64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = cls.place(left, len(levels), words)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level has; others may still be strangers, which fingerprints tell."""
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[live], level, len(bits))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & U64(1) == 1
            below = np.bitwise_count(bits[word[hit]] & ((U64(1) << bit[hit]) - U64(1)))
            out[live[hit]] = self.ranks[level][word[hit]] + below
            live = live[~hit]
        return out


def _hashed(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + U64(0x9E3779B97F4A7C15))


def _fingerprint(hashed: np.ndarray) -> np.ndarray:
    return (mix(hashed ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(32)).astype("<u4")


class ShardWriter:
    """Ids stream to the file; tables of the documents follow at the end."""

    def __init__(self, uri: str, kind: np.dtype, most_docs: int = SHARD_DOCS):
        self.uri, self.kind, self.out, self.most_docs = uri, kind, open_write(uri), most_docs
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls = self.ids = 0

    def add(self, keys: np.ndarray, nulls: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` of the documents that have one; the first ``nulls`` documents have none."""
        self.out.write(ids.tobytes())
        self.keys.append(keys)
        self.counts.append(counts)
        self.nulls += nulls
        self.ids += len(ids)

    @property
    def full(self) -> bool:
        return self.ids * self.kind.itemsize >= SHARD_BYTES or sum(map(len, self.counts)) >= self.most_docs

    def close(self) -> tuple[str, int, int, int | None, int | None]:
        """(path, documents, ids, smallest key, largest key)."""
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
        hashed = _hashed(distinct)
        table = PerfectHash.build(hashed)
        slot = table.slots(hashed)
        prints, rows, runs = (np.zeros(len(distinct), t) for t in ("<u4", "<u8", "<u4"))
        prints[slot], rows[slot], runs[slot] = _fingerprint(hashed), first + self.nulls, copies
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        levels = [x for words, ranks in zip(table.levels, table.ranks, strict=True) for x in (words, ranks[::SAMPLED].astype("<u8"))]
        for part in (offsets, keys.astype("<i8"), prints, rows, runs, np.array([len(x) for x in table.levels], "<u8"), *levels):
            self.out.write(part.tobytes())
        self.out.write(_HEAD.pack(MAGIC, self.kind.itemsize, len(table.levels), len(counts), self.nulls, len(distinct), self.ids))
        self.out.close()
        ends = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        return self.uri, len(counts), self.ids, *ends


class Shard:
    """A shard opened for reading: its head is read, everything else where it is asked for."""

    def __init__(self, uri: str):
        self.file = open_read(uri)
        self.file.seek(-_HEAD.size, 2)
        magic, width, n_levels, self.docs, self.nulls, self.distinct, self.n_ids = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.kind = np.dtype(f"<u{width}")
        at = self.n_ids * width
        self.places = {}
        for name, kind, n in (("offsets", "<u8", self.docs + 1), ("keys", "<i8", self.docs - self.nulls), ("prints", "<u4", self.distinct), ("rows", "<u8", self.distinct), ("runs", "<u4", self.distinct), ("levels", "<u8", n_levels)):
            self.places[name] = at, np.dtype(kind), n
            at += np.dtype(kind).itemsize * n
        self.levels = []
        for words in self._read("levels").tolist():
            self.levels.append((at, words))
            at += 8 * (words + -(-words // SAMPLED))

    def close(self) -> None:
        self.file.close()

    def _bytes(self, at: int, kind: np.dtype, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(kind.itemsize * n), kind)

    def _read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        at, kind, n = self.places[name]
        return self._bytes(at + kind.itemsize * lo, kind, (n if hi is None else hi) - lo)

    @cached_property
    def offsets(self) -> np.ndarray:
        return self._read("offsets").astype(np.int64)

    @cached_property
    def keys(self) -> np.ndarray:
        return self._read("keys")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first document, documents) of many keys, by the whole index; (-1, 0) for one the shard lacks."""
        table = PerfectHash([self._bytes(at, np.dtype("<u8"), words) for at, words in self.levels])
        prints, rows, runs = self._read("prints"), self._read("rows").astype(np.int64), self._read("runs")
        hashed = _hashed(keys)
        slot = table.slots(hashed)
        known = slot >= 0
        known[known] = prints[slot[known]] == _fingerprint(hashed[known])
        known[known] = self.keys[rows[slot[known]] - self.nulls] == keys[known]
        row, run = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        row[known], run[known] = rows[slot[known]], runs[slot[known]]
        return row, run

    def _slot(self, hashed: np.ndarray) -> int:
        """The slot of one key, from one bit and the count before it in each level up to its own; -1 without one."""
        u8 = np.dtype("<u8")
        for level, (at, words) in enumerate(self.levels):
            place = int(PerfectHash.place(hashed, level, words)[0])
            block, word = place // (64 * SAMPLED), place >> 6
            lo = block * SAMPLED
            near = self._bytes(at + 8 * lo, u8, min(SAMPLED, words - lo))
            own, bit = int(near[word - lo]), place & 63
            if own >> bit & 1:
                before = int(self._bytes(at + 8 * (words + block), u8, 1)[0])
                return before + int(np.bitwise_count(near[: word - lo]).sum()) + (own & ((1 << bit) - 1)).bit_count()
        return -1

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents ``first`` to ``last`` - 1."""
        ends = self._read("offsets", first, last + 1) if "offsets" not in self.__dict__ else self.offsets[first : last + 1]
        lo, hi = int(ends[0]), int(ends[-1])
        return self._bytes(lo * self.kind.itemsize, self.kind, hi - lo)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key, by a few short reads."""
        hashed = _hashed(np.array([key], np.int64))
        slot = self._slot(hashed)
        if slot < 0 or int(self._read("prints", slot, slot + 1)[0]) != int(_fingerprint(hashed)[0]):
            return []
        row, run = int(self._read("rows", slot, slot + 1)[0]), int(self._read("runs", slot, slot + 1)[0])
        if int(self._read("keys", row - self.nulls, row - self.nulls + 1)[0]) != key:
            return []
        return [self.ids(i, i + 1) for i in range(row, row + run)]


def lookup(manifest: DataFrame, key: int) -> list[np.ndarray]:
    """The ids of each document with this key, from the shards whose keys span it: one, or several in a row where
    the key repeats."""
    out = []
    for r in manifest.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard", "part").toLocalIterator():
        shard = Shard(r.path)
        out += shard.get(key)
        shard.close()
    return out


MANIFEST = "path string, shard long, part long, n_docs long, n_ids long, first_key long, last_key long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(root: str, path: str, most_docs: int, chunk: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, part_no, done = None, 0, []

        def close(w: ShardWriter) -> None:
            name, docs, n, first, last = w.close()
            done.append((name, TaskContext.get().partitionId(), part_no, docs, n, first, last))

        for b in batches:
            keys = b.column(0)
            data, offsets = text_bytes(b.column(1))
            for lo, hi in chunks(offsets, chunk):
                part = offsets[lo : hi + 1]
                ids, counts = encode(data[part[0] : part[-1]], part - part[0], path)
                out = out or ShardWriter(f"{root}/{task_tag()}-{part_no:04d}.ids", ids.dtype, most_docs)
                own = keys.slice(lo, hi - lo)
                out.add(own.drop_null().to_numpy(), own.null_count, ids, counts)
                if out.full:
                    close(out)
                    out, part_no = None, part_no + 1
        if out is not None:
            close(out)
        if done:
            kinds = (pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return write


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            shard = Shard(path)
            row, run = shard.find(shard.keys)  # the index must lead to each document
            own = np.arange(shard.nulls, shard.docs)
            if not ((row <= own) & (own < row + run)).all():
                raise ValueError(f"the index of {path} doesn't lead to its documents")
            for lo, hi in chunks(shard.offsets, CHUNK):
                ids, offsets = shard.ids(lo, hi), shard.offsets[lo : hi + 1]
                wide = ids.astype("<u4").tobytes()
                at = ((offsets - offsets[0]) * 4).tolist()
                crc = [zlib.crc32(wide[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                nulls = max(0, min(hi, shard.nulls) - lo)
                keys = [None] * nulls + shard.keys[max(0, lo - shard.nulls) : hi - shard.nulls].tolist() if hi > shard.nulls else [None] * nulls
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            shard.close()


def write_ids(docs: DataFrame, root: str, path: str, id_col: str = "doc_id", text_col: str = "text", most_docs: int = SHARD_DOCS, chunk: int = CHUNK) -> DataFrame:
    """Encode ``docs``, ``chunk`` bytes at a time, and write the shards under ``root``; their manifest."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The hash lets rows of one key be dealt over several partitions.
    order = (F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
    ordered = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("text_hash")
    return materialize(ordered.mapInArrow(lean(_writer(root, path, most_docs, chunk)), MANIFEST), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """A row per document, from the shards of the manifest, through their index. The window spans a row per shard."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("path", before.alias("before")).repartition(n).mapInArrow(lean(_reader), READ)


def op10_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(write_ids(docs, scratch(spark, "ids"), path or tokenizer_path()))
