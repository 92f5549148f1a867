"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash gives each element a random permutation of the slots and the value
``rank + uniform`` in each slot; a slot keeps its smallest value. Ranks of one
element are without replacement, which lowers the variance against MinHash. Ranks
are drawn level by level for all elements of a document: once every slot holds a
value below the level, the rest can't change anything and the document stops.

Documents with equal sets are one node from the start, so copies cost nothing
later. Nodes that share a band are compared with one leader of their bucket, then
joined to components. Nodes of a bucket that are still in different components are
compared with each other inside tasks, in blocks of bounded size: first by sketch,
then on the full sets; a task emits no pairs but a forest of the links it found.
Every link is confirmed on the full sets.

Defined cases: null and empty texts, and texts without words, have an empty set,
are linked with nothing and are kept; texts of fewer words than a shingle are one
shingle; a null ``doc_id`` is never a component's smallest unless all are null;
rows that repeat an id with the component's smallest id are all marked kept; an empty
table gives an empty result; extra columns are ignored. :func:`keep_one_each` tells rows
apart by id and text, so exactly one row of each component stays, whichever ids are
repeated or null, and a row without words always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import ONE_TASK_EDGES, UnionFind, connected_components
from .store import BROADCAST_ROWS, bounded_batches, free, lean, materialize, scope, sized
from .textscan import NON_SPACE, U64, Words, chunks, mix, text_bytes

SLOTS = 96
BAND_ROWS = 4
BANDS = SLOTS // BAND_ROWS
#: Of two sets with similarity 0.8, 96 one-bit values differ in 9.6 on average (deviation 2.9).
MOST_BITS = 30
SHINGLE_WORDS = 5
PERCENT = 80
CHUNK = 1 << 20
#: Nodes of a bucket's block on average, and shingles in all their sets; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Columns of the bit matrix that are built at a time.
COLUMNS = 1 << 14
_LEVEL = 40
_GOLDEN = U64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): sorted distinct shingle hashes of all documents, and where each one's begin."""
    words = Words(data, offsets, NON_SPACE)
    w, counts = words.hashes, words.counts
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    if not len(w):
        return np.zeros(0, np.uint64), first
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[doc] + words.first[:-1][doc]
    width = np.minimum(counts, k)[doc]
    acc = width.astype(np.uint64) * _GOLDEN
    for i in range(k):
        more = width > i
        if more.all():
            acc = mix(acc * U64(0xD6E8FEB86659FD93) + w[at + i])
        else:
            acc[more] = mix(acc[more] * U64(0xD6E8FEB86659FD93) + w[at[more] + i])
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        acc[lo:hi].sort()
    fresh = np.ones(len(acc), bool)
    fresh[1:] = acc[1:] != acc[:-1]
    starts = first[:-1][n > 0]
    fresh[starts] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return acc[fresh], kept[first]


def super_minhash(hashes: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures [documents, slots] of sets given as by :func:`shingle_sets`; sets must not be empty."""
    docs = len(first) - 1
    sig = np.full(docs * slots, np.iinfo(np.uint64).max, np.uint64)
    live, owner = np.ones(docs, bool), np.repeat(np.arange(docs), np.diff(first))
    elements, ranks = hashes, None
    for level in range(slots):
        if level:
            # The slot with the highest rank decides whether this level can still lower it.
            live = (sig.reshape(docs, slots) >> U64(_LEVEL)).max(axis=1) >= level
            stay = live[owner]
            if not stay.any():
                break
            if ranks is None:
                elements, owner = elements[stay], owner[stay]
                ranks = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                x = mix(elements + _GOLDEN)
                k = ((x & U64(0xFFFFFF)) % U64(slots)).astype(np.int64)
                _swap(ranks, 0, k)
            elif not stay.all():
                elements, owner, ranks = elements[stay], owner[stay], ranks[stay]
        x = mix(elements + U64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64))
        k = level + ((x & U64(0xFFFFFF)) % U64(slots - level)).astype(np.int64)
        slot = k if ranks is None else _swap(ranks, level, k)
        np.minimum.at(sig, owner * slots + slot, (x >> U64(24)) | U64(level << _LEVEL))
    return sig.reshape(docs, slots)


def _swap(ranks: np.ndarray, level: int, k: np.ndarray) -> np.ndarray:
    """A step of each element's own shuffle: what it draws for ``level``."""
    rows = np.arange(len(ranks))
    drawn = ranks[rows, k].astype(np.int64)
    ranks[rows, k] = ranks[:, level]
    ranks[:, level] = drawn
    return drawn


def _binary(blob: bytes, width: int, valid: np.ndarray) -> pa.Array:
    """A binary column of fixed width; rows that aren't valid are null."""
    offsets = np.concatenate([[0], np.cumsum(np.where(valid, width, 0))]).astype(np.int32)
    mask = pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(valid), [mask, pa.py_buffer(offsets), pa.py_buffer(blob)])


def _nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each non-empty set."""
    starts = first[:-1]
    a = np.add.reduceat(mix(hashes ^ U64(0xA0761D6478BD642F)), starts)
    b = np.add.reduceat(mix(hashes ^ U64(0xE7037ED1A0B428DB)), starts)
    size = np.diff(first).astype(np.uint64)
    return np.stack([mix(a + size), mix(b ^ size)], axis=1)


SIGNED = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, s1 long, s2 long"


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for lo, hi in chunks(offsets, CHUNK):
                part = offsets[lo : hi + 1]
                hashes, first = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
                n = np.diff(first)
                valid = n > 0
                packed = np.concatenate([first[:-1][valid], first[-1:]])
                count = int(valid.sum())
                sketch = np.zeros((len(n), 2), np.int64)
                if count:
                    sig = super_minhash(hashes, packed)
                    rows = sig.reshape(count, BANDS, BAND_ROWS)
                    band = np.tile(np.arange(BANDS, dtype=np.uint64) * _GOLDEN, (count, 1))
                    for i in range(BAND_ROWS):
                        band = mix(band * U64(0xD6E8FEB86659FD93) + rows[:, :, i])
                    bits = np.zeros((count, 128), np.uint8)
                    bits[:, :SLOTS] = (mix(sig) & U64(1)).astype(np.uint8)
                    sketch[valid] = np.packbits(bits, axis=1).view(np.int64)
                    node = _nodes(hashes, packed).tobytes()
                    values = band.view(np.int64).ravel()
                else:
                    node, values = b"", np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(valid, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_buffers(pa.list_(pa.int64()), len(n), [pa.array(valid).buffers()[1], pa.py_buffer(ends)], children=[pa.array(values)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), _binary(node, 16, valid), bands, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands", "s1", "s2"],
                )

    return sign


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            for lo, hi in chunks(offsets, CHUNK):
                part = offsets[lo : hi + 1]
                hashes, first = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
                valid = np.diff(first) > 0
                if valid.any():
                    packed = np.concatenate([first[:-1][valid], first[-1:]])
                    ends = (packed * 8).astype(np.int32)
                    blob = pa.Array.from_buffers(pa.binary(), len(packed) - 1, [None, pa.py_buffer(ends), pa.py_buffer(hashes.tobytes())])
                    yield pa.RecordBatch.from_arrays([_binary(_nodes(hashes, packed).tobytes(), 16, np.ones(len(packed) - 1, bool)), blob], names=["node", "shingles"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(mask)

    return confirm


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with equal first three columns, which stand together. Groups over several batches stay in several chunks,
    as binary values of more than 2 GB don't fit into one."""
    key, parts = None, []
    for b in batches:
        columns = [b.column(i).to_numpy() for i in range(3)]
        fresh = np.zeros(b.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(fresh).tolist(), b.num_rows] if b.num_rows else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(int(c[lo]) for c in columns)
            if parts and own != key:
                yield pa.Table.from_batches(parts)
                parts = []
            key = own
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _differ(column: pa.ChunkedArray) -> np.ndarray:
    codes = column.combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[:, None] != codes[None, :]


def _hopeful(percent: int):
    """Nodes that size and sketch allow to be linked with one of another component in their blocks, once a task."""

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for g in _groups(batches):
            if g.num_rows < 2:
                continue
            n, s1, s2 = g.column(5).to_numpy(), *(g.column(i).to_numpy().view(np.uint64) for i in (6, 7))
            bits = np.bitwise_count(s1[:, None] ^ s1[None, :]) + np.bitwise_count(s2[:, None] ^ s2[None, :])
            fits = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
            some = (_differ(g.column(4)) & fits & (bits <= MOST_BITS)).any(axis=1)
            if some.any():
                fresh = {x for x in g.column(3).filter(pa.array(some)).to_pylist() if x not in told}
                if fresh:
                    told |= fresh
                    yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary())], names=["node"])

    return hopeful


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from a bit matrix over the elements that any two share."""
    sizes = np.array([len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[code] > 1
    row, column = owner[shared], place[code[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    total = int((times > 1).sum())
    for lo in range(0, total, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        bits = np.zeros((len(sets), 64 * -(-min(COLUMNS, total - lo) // 64)), bool)
        bits[row[i:j], column[i:j] - lo] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(len(sets)):
            out[k, k:] += np.bitwise_count(packed[k] & packed[k:]).sum(axis=1, dtype=np.int64)
    return np.maximum(out, out.T)


def _forest(percent: int):
    """Links between components, as a forest for each pair of blocks."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            if g.num_rows < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(5)]
            n = np.array([len(x) for x in sets])
            common = common_sizes(sets)
            linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & _differ(g.column(4))
            if linked.any():
                union, node, found = UnionFind(), g.column(3).to_pylist(), []
                for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
                    if union.find(int(i)) != union.find(int(j)):
                        union.union(int(i), int(j))
                        found.append((node[i], node[j]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["u", "v"])

    return forest


def row_hash(text: Column) -> Column:
    """Tells texts of rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class NearDuplicates:
    """The steps of one run; ``signed`` has a row per document, ``classes`` a row per distinct set.

    ``block`` and ``block_shingles`` bound what a task compares at a time, ``one_task`` the edges
    that one task may merge; none of them changes the result.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        words: int = SHINGLE_WORDS,
        percent: int = PERCENT,
        block: int = BLOCK,
        block_shingles: int = BLOCK_SHINGLES,
        one_task: int = ONE_TASK_EDGES,
    ):
        text = F.col(text_col)
        self.docs = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text).alias("text_hash"), text.alias("text"))
        self.words, self.percent = words, percent
        self.block, self.block_shingles, self.one_task = block, block_shingles, one_task
        self.signed = materialize(self.docs.mapInArrow(lean(_sign(words)), SIGNED), "minhash-signed")
        # The first row of a class by id, nulls last.
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
        classes = self.signed.filter("node IS NOT NULL").groupBy("node").agg(
            rep.alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2")
        )
        self.classes = materialize(classes, "minhash-classes")

    def run(self) -> DataFrame:
        """Per document: doc_id, text_hash, n_shingles, first (the first row of its component; null without words)."""
        with scope(self.docs.sparkSession) as keep:
            by_node = self._named()
            keep.append(by_node)
        return self.signed.select("doc_id", "text_hash", "n_shingles", "node").join(by_node, "node", "left").drop("node")

    def _named(self) -> DataFrame:
        """(node, first), written."""
        buckets = self._buckets()
        most = buckets.count() // 2  # keys, as each has two nodes at least
        links = self._verified(self._leader_pairs(buckets, most))
        merged = connected_components(links, self.one_task)
        apart = self._apart(buckets, merged, most)
        dealt = self._blocks(apart, ["node", "component", "n", "s1", "s2"], most)
        hopeful = dealt.mapInArrow(lean(_hopeful(self.percent)), "node binary").distinct()
        sets = self._sets_of(hopeful.join(self.classes.select("node", "rep"), "node"))
        rows = apart.select("key", "node", "component", "n").join(sets, "node")
        more = self._blocks(rows, ["node", "component", "shingles"], most).mapInArrow(lean(_forest(self.percent)), "u binary, v binary")
        return self._result(connected_components(links.union(more), self.one_task))

    def _buckets(self) -> DataFrame:
        """(key, node) of the buckets with at least two nodes."""
        rows = self.classes.select(F.explode("bands").alias("key"), "node")
        many = rows.groupBy("key").count().filter("count > 1").select("key")
        return materialize(rows.join(sized(many, "minhash-keys"), "key", "left_semi"), "minhash-buckets")

    def _leader_pairs(self, buckets: DataFrame, most: int) -> DataFrame:
        """Each node with its bucket's leader."""
        leaders = sized(buckets.groupBy("key").agg(F.min("node").alias("lead")), "minhash-leaders", bound=most)
        return buckets.join(leaders, "key").filter("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct()

    def _apart(self, buckets: DataFrame, merged: DataFrame, most: int) -> DataFrame:
        """(key, node, component, n, s1, s2) of the buckets that hold nodes of several components."""
        facts = self.classes.select("node", "n", "s1", "s2").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = materialize(buckets.join(facts, "node"), "minhash-rows")
        several = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
        return rows.join(sized(several, "minhash-several", bound=most), "key", "left_semi")

    def _blocks(self, rows: DataFrame, columns: list[str], most: int) -> DataFrame:
        """The rows of each bucket dealt into pairs of blocks, which stand together and in order."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = F.greatest(F.ceil(F.count("*") / self.block), F.ceil(F.sum("n") / self.block_shingles)).cast("int")
        sizes = rows.groupBy("key").agg(blocks.alias("blocks")).filter("blocks > 1")
        dealt = rows.join(sized(sizes, "minhash-sizes", bound=most), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *columns)
        return dealt.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")

    def _possible(self):
        fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        bits = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
        return fits & (bits <= MOST_BITS)

    def _sets_of(self, wanted: DataFrame, bound: int | None = None) -> DataFrame:
        """(node, shingles) of the nodes in ``wanted`` (node, rep; ``bound`` rows at most), from the texts of their documents."""
        if bound is None or bound > BROADCAST_ROWS:
            wanted = materialize(wanted, "minhash-wanted")
            bound = wanted.count()
        ids = wanted.select(F.col("rep.doc_id").alias("want"), F.col("rep.text_hash").alias("want_hash")).distinct()
        if bound <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        same = F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("text_hash") == F.col("want_hash"))
        texts = self.docs.join(ids, same, "left_semi").select("text")
        sets = texts.mapInArrow(lean(_sets(self.words)), "node binary, shingles binary")
        return materialize(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "minhash-sets")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        facts = self.classes.select("node", "rep", "n", "s1", "s2")
        a = facts.select(*[F.col(c).alias(f"{c}_a") for c in facts.columns])
        b = facts.select(*[F.col(c).alias(f"{c}_b") for c in facts.columns])
        known = pairs.join(a, F.col("u") == F.col("node_a")).join(b, F.col("v") == F.col("node_b")).filter(self._possible())
        known = materialize(known.select("u", "v", "rep_a", "rep_b"), "minhash-pairs")
        sets = self._sets_of(known.select(F.col("u").alias("node"), F.col("rep_a").alias("rep")).union(known.select("v", "rep_b")).distinct(), 2 * known.count())
        left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
        both = known.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "x", "y")
        return materialize(both.mapInArrow(lean(_confirm(self.percent)), "u binary, v binary"), "minhash-links")

    def _result(self, merged: DataFrame) -> DataFrame:
        # Only components of several nodes need their first row found; most nodes are alone.
        roots = merged.select(F.col("component").alias("node"), "component").distinct()
        reps = self.classes.select("node", "rep")
        least = merged.select("node", "component").union(roots).join(reps, "node").groupBy("component").agg(F.min("rep").alias("first"))
        named = reps.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.join(sized(least, "minhash-first", bound=merged.count()), "component", "left").select("node", F.coalesce("first", "rep").alias("first"))
        return materialize(named, "minhash-named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, **bounds) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document of ``docs``."""
    rows = NearDuplicates(docs, id_col, text_col, words, percent, **bounds).run()
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT, **bounds) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; columns unchanged."""
    rows = NearDuplicates(docs, id_col, text_col, words, percent, **bounds).run().filter("first IS NOT NULL")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    found = rows.groupBy("doc_id", "text_hash").agg(F.bool_and(stays).alias("stays"), F.count("*").alias("copies")).filter("NOT stays OR copies > 1")
    own, of, mark, stay = free(docs, "own_hash", "of_id", "of_hash", "stay")
    found = sized(found.select(F.col("doc_id").alias(of), F.col("text_hash").alias(mark), F.col("stays").alias(stay)), "minhash-found")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(mark))
    known = docs.withColumn(own, row_hash(F.col(text_col))).join(found, same, "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = known.filter(F.col(stay).isNull()).select(*names)
    if found.filter(stay).limit(1).count():
        # Rows that repeat both id and text: one of them stays.
        out = out.union(known.filter(stay).dropDuplicates([of, mark]).select(*names))
    return out


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
