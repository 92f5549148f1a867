"""Connected components of an edge table by union-find, without a driver-side graph.

Each partition first contracts its own edges with a union-find forest of bounded size. Where
what is left is small, one task finishes it; beyond ``ONE_TASK_EDGES``, the stars are merged by
alternating large-star and small-star steps until they no longer change. The tables of
each step are written to the shared folder; a star's centre meets its edges by broadcast, or
in a join of plain exchanges, whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, lean, materialize, sized, table_dir

ROUNDS = 60
#: Edges that one task may finish; its forest then takes some 150 MB at most.
ONE_TASK_EDGES = 500_000
#: Nodes that a partition's forest holds before it is emitted and a new one begun.
FOREST_NODES = 500_000


class UnionFind:
    """Union-find over any ordered keys; a set's root is its smallest member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(most: int | None):
    """Edges of a partition -> (u, v) with v the root of u, in forests of about ``most`` nodes (None: in one)."""

    def emit(forest: UnionFind, kinds) -> Iterator[pa.RecordBatch]:
        pairs = [(x, r) for x in list(forest.parent) if (r := forest.find(x)) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pairs, strict=True), kinds, strict=True)], names=["u", "v"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kinds = UnionFind(), None
        for b in batches:
            kinds = b.schema.types
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.union(u, v)
            if most is not None and len(forest.parent) >= most:
                yield from emit(forest, kinds)
                forest = UnionFind()
        yield from emit(forest, kinds)

    return contract


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = sized(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES, forest: int = FOREST_NODES) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v) that isn't its component's smallest."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["u"]
    contract = f"u {kind}, v {kind}"
    state = materialize(edges.filter("u <> v").mapInArrow(lean(_contract(forest)), contract), "components")
    if state.count() <= one_task:
        whole = materialize(state.coalesce(1).mapInArrow(lean(_contract(None)), contract), "components")
        discard(spark, table_dir(state))
        return whole.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(ROUNDS):
        got = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if got == mark or got.n == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = got
        large = materialize(_large_star(state), "components")
        after = materialize(_small_star(large), "components")
        for t in (state, large):
            discard(spark, table_dir(t))
        state = after
    raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
