"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree splits a bounded sample at the median of its projection on the difference of
two random members, level by level. All vectors are then sent down all trees; only the
planes on a vector's path are looked at. The index is a written table of a row per vector:
its block, the vector, and its leaf in each tree.

A query searches the forest through one priority queue: the entry with the largest margin
is opened next, whichever tree it belongs to, until the opened leaves hold ``SEARCH`` times
as many entries as there are vectors (or ``budget`` entries, where given). Margins of the
upper levels come from one product, those below a node when the node is opened. The query
then visits each block once with the list of its leaves, meets the block's members of those
leaves, and leaves with its best few, reranked by exact inner product in double precision.
A vector travels once, however many trees there are; products are taken leaf by leaf, for
all queries that opened it.

Inner products become distances on a sphere by one more coordinate,
``sqrt(max norm^2 - norm^2)``, which only the trees see; queries enter with the largest
norm. Where norms are uneven, the longest vectors (one in ``LONG``, and those as long) are
candidates of every query, as they may score high at any angle. Equal vectors are one candidate
with their smallest ids, so thousands of copies cost one product.

What the tasks get of the forest is bounded: at most ``PLANE_NUMBERS`` single-precision
numbers, for which vectors of many dimensions get fewer levels.

On vectors without structure, recall needs many candidates: with 64 nearly independent
dimensions, the default search opens leaves that hold some 65 % of the vectors, for a
recall above 0.95. ``search`` and ``budget`` are parameters; clustered vectors need less.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null id or with another length than the most common one (the
shorter of equally common ones); of rows that repeat a vec_id, the one with the smallest
vector counts; equal scores go to the smaller vec_id; products beyond the range of doubles
are infinite, and where infinities cancel the score is NaN, which ranks last; with fewer
candidates, all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import bounded_batches, lean, materialize

TREES = 24
SEARCH = 1.2
#: Rows of the sample that the trees are fitted on, and its numbers at most.
SAMPLE, SAMPLE_NUMBERS = 20_000, 1 << 21
LEAF = 256
#: Depth for small tables, and at most; the planes' numbers in all.
LEAST_DEPTH, MOST_DEPTH, PLANE_NUMBERS = 6, 12, 1 << 23
#: Levels whose margins a query takes at once.
UPPER = 8
#: A block's vectors and their numbers, at most on average; least number of blocks.
BLOCK_ROWS, BLOCK_NUMBERS, LEAST_BLOCKS = 1 << 14, 1 << 21, 12
#: Queries and opened leaves that a block meets at a time, and candidates held before they are thinned out.
MEET_QUERIES, MEET_LEAVES, HELD = 4096, 1 << 21, 1 << 20
#: One in so many vectors is long enough to meet every query, where norms are uneven.
LONG = 32
SEED = 20240229


def sound(v: Column) -> Column:
    """Vectors that take part."""
    least, most = F.array_min(v), F.array_max(v)  # NaN counts as the largest
    return F.coalesce(F.forall(v, lambda x: x.isNotNull()) & (most < float("inf")) & (least > float("-inf")) & ((most != 0) | (least != 0)), F.lit(False))


@dataclass
class Forest:
    """``planes`` [trees, 2 ** depth - 1, dimension + 1] and ``cuts`` [trees, 2 ** depth - 1], of vectors times
    ``scale``, whose largest norm is then ``norm``."""

    planes: np.ndarray
    cuts: np.ndarray
    scale: float
    norm: float
    #: Vectors of this squared norm (scaled) or more are candidates of every query.
    long: float = np.inf

    @property
    def depth(self) -> int:
        return int(np.log2(self.cuts.shape[1] + 1))

    @property
    def leaf_count(self) -> int:
        return self.cuts.shape[1] + 1

    def lift(self, v: np.ndarray) -> np.ndarray:
        """Scaled vectors on the sphere."""
        x = v * self.scale
        rest = np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x))
        return np.column_stack([x, np.sqrt(rest)])

    def codes(self, v: np.ndarray) -> np.ndarray:
        """[vectors, trees + 1]: tree * leaves + leaf of each tree, and a code behind them all for long vectors, else -1."""
        x = self.lift(v)
        far = np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]) >= self.long
        x = x.astype(np.float32)
        out = np.empty((len(v), len(self.planes) + 1), np.int32)
        for t, (h, c) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.zeros(len(v), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, h[node]) > c[node])
            out[:, t] = t * self.leaf_count + node - len(c)
        out[:, -1] = np.where(far, len(self.planes) * self.leaf_count, -1)
        return out

    def directions(self, q: np.ndarray) -> np.ndarray:
        """Queries with the sphere's norm, as only their direction decides. First by the largest component, so that
        no square under- or overflows."""
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        return (unit * (self.norm / np.linalg.norm(unit, axis=1, keepdims=True))).astype(np.float32)

    def below(self, node: int) -> np.ndarray:
        """The nodes of a subtree."""
        out, level = [], np.array([node])
        while level[0] < self.cuts.shape[1]:
            out.append(level)
            level = np.concatenate([2 * level + 1, 2 * level + 2])
        return np.concatenate(out)

    def search(self, queries: np.ndarray, sizes: np.ndarray, wanted: float) -> Iterator[np.ndarray]:
        """Codes that each query opens, in the order of the shared queue, until they hold ``wanted`` entries."""
        nodes, trees = self.cuts.shape[1], len(self.planes)
        known = 2 ** min(self.depth, UPPER) - 1
        counts = sizes.tolist()
        q = self.directions(queries)
        upper = np.einsum("qd,tnd->qtn", q, self.planes[:, :known, :-1], optimize=True) - self.cuts[:, :known]
        for i in range(len(q)):
            rows, lower = upper[i].tolist(), {}
            heap = [(-np.inf, t, 0) for t in range(trees)]
            got, held = [], 0.0
            while heap and held < wanted:
                worst, t, node = heapq.heappop(heap)
                if node >= nodes:
                    got.append(t * self.leaf_count + node - nodes)
                    held += counts[t][node - nodes]
                    continue
                if node < known:
                    m = rows[t][node]
                else:
                    if (t, node) not in lower:
                        sub = self.below(node)
                        values = self.planes[t, sub, :-1] @ q[i] - self.cuts[t, sub]
                        lower.update(zip(((t, n) for n in sub.tolist()), values.tolist(), strict=True))
                    m = lower[t, node]
                heapq.heappush(heap, (max(worst, m), t, 2 * node + 1))
                heapq.heappush(heap, (max(worst, -m), t, 2 * node + 2))
            if np.isfinite(self.long):
                got.append(trees * self.leaf_count)
            yield np.array(got, np.int32)


def fit(sample: np.ndarray, rows: int, log_norm: float, trees: int = TREES, seed: int = SEED) -> Forest:
    """A forest for ``rows`` vectors, from a sample of them; ``log_norm`` is the base-2 logarithm of the largest norm."""
    rng = np.random.default_rng(seed)
    small = min(LEAST_DEPTH, int(np.ceil(np.log2(max(2, rows / 8)))))
    depth = min(MOST_DEPTH, max(small, int(np.ceil(np.log2(max(2, rows / LEAF))))))
    width = sample.shape[1] + 1
    depth = max(1, min(depth, int(np.log2(PLANE_NUMBERS / (trees * width) + 1))))
    exponent = np.ceil(log_norm)
    forest = Forest(np.zeros((trees, 2**depth - 1, width), np.float32), np.zeros((trees, 2**depth - 1), np.float32), float(np.exp2(-exponent)), float(np.exp2(log_norm - exponent)))
    x = forest.lift(sample)
    square = np.sort(np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]))
    if len(square) and forest.norm**2 > 2 * square[len(square) // 2]:
        forest.long = float(max(square[-max(1, len(square) // LONG)], 2 * square[len(square) // 2]))
    for t in range(trees):
        members = [np.arange(len(x))]
        for node in range(2**depth - 1):
            m = members[node]
            if len(m) >= 2:
                a, b = rng.choice(len(m), 2, replace=False)
                h = x[m[a]] - x[m[b]]
            else:
                h = np.zeros(x.shape[1])
            if not h.any():
                h = rng.normal(size=x.shape[1])
            h /= np.linalg.norm(h)
            p = x[m] @ h
            cut = float(np.median(p)) if len(m) else 0.0
            forest.planes[t, node], forest.cuts[t, node] = h, cut
            members += [m[p <= cut], m[p > cut]]
    return forest


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _rows(block, kind: int, ids: np.ndarray, v: pa.Array, codes: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, pa.int64()), v, codes], names=["block", "kind", "id", "v", "codes"])


def _index(forest: Forest, blocks: int):
    """A row per vector: its block, dealt by number, and its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                ids = part.column(0).to_numpy()
                codes = forest.codes(_matrix(part.column(1)))
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * codes.shape[1])
                yield _rows(_dealt(ids, blocks), 0, ids, part.column(1), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())))

    return run


def _dealt(ids: np.ndarray, blocks: int) -> np.ndarray:
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)


def _asked(forest: Forest, blocks: int, sizes: np.ndarray, wanted: float):
    """Each query with its opened leaves, once for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, opened = part.column(0).to_numpy(), list(forest.search(_matrix(part.column(1)), sizes, wanted))
                codes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, opened)]).astype(np.int32)), pa.array(np.concatenate(opened)))
                for block in range(blocks):
                    yield _rows(np.full(len(ids), block, np.int32), 1, ids, part.column(1), codes)

    return run


class Block:
    """Vectors of a block, and its members by code."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, scale: float):
        self.ids, self.v, self.near = ids, v, v * scale
        flat = codes.T.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]
        self.member = order % len(ids)
        self.codes, self.first = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.first[1:], len(order))

    def nearest(self, q: np.ndarray, owner: np.ndarray, code: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, score) of each query's best; ``owner`` and ``code`` are the queries' opened leaves."""
        # Scaled by powers of two, which keep a query's order and can't overflow.
        small = q * np.exp2(-np.ceil(np.log2(np.abs(q).max(axis=1))))[:, None]
        slack = 1e-12 * np.linalg.norm(small, axis=1)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        asked, begin = np.unique(code, return_index=True)
        end = np.append(begin[1:], len(code))
        at = np.minimum(np.searchsorted(self.codes, asked), max(0, len(self.codes) - 1))
        both = np.flatnonzero(self.codes[at] == asked) if len(self.codes) else []
        least, held, n = np.full(len(q), -np.inf), [], 0
        for i in both:
            m, o = self.member[self.first[at[i]] : self.ends[at[i]]], owner[begin[i] : end[i]]
            product = self.near[m] @ small[o].T
            r, c = np.nonzero(product >= least[o])
            if len(r):
                held.append((o[c], m[r], product[r, c]))
                n += len(r)
            if n > HELD:
                held = [self._thin(held, least, slack, best)]
                n = len(held[0][0])
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        o, m, _ = self._thin(held, least, slack, best)
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.concatenate([(self.v[m[i : i + 65536]] * q[o[i : i + 65536]]).sum(axis=1) for i in range(0, len(o), 65536)])
        order = np.lexsort((self.ids[m], -np.fmax(exact, -np.inf), o))
        o, m, exact = o[order], m[order], exact[order]
        keep = np.arange(len(o)) - np.searchsorted(o, o) < best
        return o[keep], m[keep], exact[keep]

    def _thin(self, held: list, least: np.ndarray, slack: np.ndarray, best: int):
        """Distinct candidates that may still be among a query's best; ``least`` rises to what it takes."""
        o, m, p = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first = np.unique(o * len(self.ids) + m, return_index=True)
        o, m, p = o[first], m[first], p[first]
        order = np.lexsort((-p, o))
        o, m, p = o[order], m[order], p[order]
        last = np.flatnonzero(np.arange(len(o)) - np.searchsorted(o, o) == best - 1)
        # A product by blocks may differ in the last digits from the exact one.
        least[o[last]] = p[last] - slack[o[last]]
        keep = p >= least[o]
        return o[keep], m[keep], p[keep]


def _meet(best: int, scale: float):
    """Per block: its vectors come first, then the queries; the best few of each."""

    def answers(block: Block, parts: list) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([p.column(2).to_numpy() for p in parts])
        codes = [p.column(4) for p in parts]
        owner = np.repeat(np.arange(len(ids)), np.concatenate([np.diff(c.offsets.to_numpy()) for c in codes]))
        q = np.concatenate([_matrix(p.column(3)) for p in parts])
        who, member, score = block.nearest(q, owner, np.concatenate([c.flatten().to_numpy() for c in codes]), best)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(block.ids[member]), pa.array(score)], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, members, block, waiting = None, [], None, []

        def flush():
            if waiting and block is not None:
                yield from answers(block, waiting)
            waiting.clear()

        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.zeros(len(blocks), bool)
            fresh[1:] = (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])
            cuts = [0, *np.flatnonzero(fresh).tolist(), len(blocks)] if len(blocks) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[lo] != number:
                    yield from flush()
                    number, members, block = blocks[lo], [], None
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    members.append((part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).flatten().to_numpy().reshape(hi - lo, -1)))
                    continue
                if block is None and members:
                    block = Block(*(np.concatenate(x) for x in zip(*members, strict=True)), scale)
                    members = []
                waiting.append(part)
                if sum(p.num_rows for p in waiting) >= MEET_QUERIES or sum(len(p.column(4).flatten()) for p in waiting) >= MEET_LEAVES:
                    yield from flush()
        yield from flush()

    return run


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, trees: int = TREES, search: float = SEARCH, budget: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each row that ``queries`` (a
    condition on ``vec_id``) picks, among all other rows."""
    kind = "float" if dict(rows.dtypes)[vector_col] == "array<float>" else "double"
    base = bounded_batches(rows).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    base = materialize(base.filter(F.col("vec_id").isNotNull() & sound(F.col("v"))), "ann-sound")
    length = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return rows.sparkSession.createDataFrame([], result)
    base = base.filter(F.size("v") == length.d)
    if base.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        base = materialize(base.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-base")
    classes = materialize(base.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "ann-classes")
    n, largest = classes.agg(F.count("*"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).cast("double")).first()
    # The largest norm's logarithm, from shares of the largest component, as squares may overflow.
    share = lambda x: x.cast("double") / largest
    square = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + share(x) * share(x)))).first()[0]
    most = float(np.log2(largest) + np.log2(square) / 2)
    sample = classes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(2, min(SAMPLE, SAMPLE_NUMBERS // length.d))).select("v").toArrow()
    forest = fit(_matrix(sample.column(0).combine_chunks()), n, most, trees)
    blocks = max(LEAST_BLOCKS, -(-n // max(1, min(block_rows, BLOCK_NUMBERS // length.d))))
    row = f"block int, kind int, id long, v array<{kind}>, codes array<int>"
    index = materialize(classes.select("id", "v").mapInArrow(lean(_index(forest, blocks)), row), "ann-index")
    sizes = np.zeros((trees, forest.leaf_count), np.int64)
    # A row per leaf, of which there are trees * 2 ** 12 at most.
    for r in index.select(F.explode(F.slice("codes", 1, trees)).alias("code")).groupBy("code").count().collect():
        sizes[divmod(r.code, forest.leaf_count)] = r["count"]
    asked = base.filter(queries).select(F.col("vec_id").alias("id"), "v")
    # One more than asked for: the query itself is among the candidates. A vector is in one leaf of each
    # tree, so trees * best entries are at least ``best`` different candidates.
    best = k + 1
    wanted = max(search * n if budget is None else min(budget, search * n), trees * best)
    everything = index.union(asked.mapInArrow(lean(_asked(forest, blocks, sizes, wanted)), row))
    found = everything.repartitionById(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(lean(_meet(best, forest.scale)), "query_id long, id long, score double")
    # NaN would sort before all numbers.
    score = F.nanvl("score", F.lit(float("-inf")))
    found = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(score.desc(), "id"))).filter(F.col("r") <= best)
    # The smallest ids of vectors that occur several times, first within salted parts.
    many = classes.filter("copies > 1").select("v", "id")
    copies = base.join(many, "v").select("id", "vec_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["id", "salt"], ["id"]):
        copies = copies.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).filter(F.col("r") <= best).drop("r")
    named = found.drop("r").join(copies.drop("salt"), "id", "left").withColumn("vec_id", F.coalesce("vec_id", "id"))
    ranked = named.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(score.desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
