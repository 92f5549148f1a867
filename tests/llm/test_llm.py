"""The operators of the llm folder against brute force, round trips and odd inputs."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoebox.llm import ann, components, exact_dedup, lattice, license_scan, minhash, mixing, piece_sampling, segments, store, textscan, token_counts, token_files, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names also occur inside the operators.
EXTRA = "node string, key string, count string, rank string, size string, h string, row string, component string, u string, v string"
DOCS = "doc_id long, text string, source string, " + EXTRA
LONG = "lorem ipsum dolor " * 30_000


def documents(spark, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], DOCS)


ODD = [
    (1, "a b c d e f g h", "s"),
    (2, "a  b\tc d e f g h", "s"),
    (2, "a  b\tc d e f g h", "s"),
    (None, "a b c d e f g h", None),
    (3, None, "t"),
    (4, "", "t"),
    (5, "one", "t"),
    (6, " \n ", None),
    (7, LONG, "u"),
    (8, LONG, "u"),
    (9, "É ▁ ß 日本 😀 \x00 <|endoftext|>", "u"),
]


# Shared tools.
texts = st.lists(st.text(alphabet=st.sampled_from("aAbé \n\t▁日😀1.' 　 "), max_size=30), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(rows):
    data, offsets = textscan.text_bytes(pa.array([*rows, None], pa.string()))
    w = textscan.Words(data, offsets, textscan.NON_SPACE)
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    want = [WORD.findall(t.translate(LOWER)) for t in [*rows, ""]]
    assert got == [x for t in want for x in t] and w.counts.tolist() == [len(t) for t in want]
    by = defaultdict(set)
    for x, h in zip(got, w.hashes.tolist()):
        by[x].add(h)
    assert all(len(h) == 1 for h in by.values()) and len({min(h) for h in by.values()}) == len(by)


def test_hash_index():
    rng = np.random.default_rng(1)
    index, keys = segments.HashIndex(1000), rng.integers(1, 2**63, 1000).astype(np.uint64)
    keys = np.unique(keys)
    index.add(keys[:600])
    index.add(keys[600:])
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 1


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    union = components.UnionFind()
    for a, b in pairs:
        union.union(a, b)
    want = {x: r for x in union.parent if (r := union.find(x)) != x}
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(4)
    for one_task in (0, 10**6):
        assert {r.node: r.component for r in components.connected_components(edges, one_task).collect()} == want
    assert components.connected_components(edges.limit(0)).count() == 0


def test_segment_cache_begins_anew():
    """Beyond its bound a cache starts again and still gives each segment its own value."""
    rows = segments.Rows(size=np.int64)
    cache = segments.SegmentCache(20, lambda s, which: rows.append(np.ones(len(which), np.int64), size=(s.ends - s.starts)[which]), rows)
    for n in (5, 15, 30, 3, 60):
        text = " ".join("x" * (i % 50 + 1) + chr(97 + i % 26) for i in range(n)).encode()
        data = np.frombuffer(text, np.uint8)
        seg = segments.Segments(data, np.array([0, len(data)]), segments.cut_before_words(data))
        at = cache.resolve(seg)
        assert (rows.columns["size"][at] == seg.ends - seg.starts).all()


def test_sized_tables(spark):
    """A table beyond the bound is joined without a broadcast hint, with the same rows."""
    left, right = spark.range(100).selectExpr("id % 10 AS k", "id"), spark.range(7).selectExpr("id AS k", "id * 2 AS x")
    plans = []
    for most in (3, 100):
        joined = left.join(store.sized(right, "t", most), "k")
        plans.append("strategy=broadcast" in joined._jdf.queryExecution().analyzed().toString())
        assert joined.count() == 70
    assert plans == [False, True]


def test_scope_discards(spark):
    with store.scope(spark) as keep:
        a, b = store.materialize(spark.range(3).toDF("x"), "t"), store.materialize(spark.range(4).toDF("x"), "t")
        keep.append(b)
    assert b.count() == 4 and not os.path.exists(store.table_dir(a).removeprefix("file:").replace("//", "/", 1))


# 1. WARC.
def test_warc(spark):
    pages = [(1, "http://a/ \r\nX", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "x" * 200), (None, "n", "z" * 300), (7, "u", "é" * 50), (8, "u", "é" * 50), (1, "u", "x" * 200)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, key string")
    manifest = warc.write_archives(df, store.scratch(spark, "t"))
    got = Counter(tuple(r) for r in warc.read_archives(manifest).collect())
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
        head = min(same) if len(raw) >= 100 and same else None
        revisit = head is not None and i != head
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", head if revisit else None)] += 1
    assert got == want
    hits = [h for r in manifest.collect() for h in warc.lookup(r.path, 7)]
    assert len(hits) == 1 and hits[0][1].endswith(("é" * 50).encode())
    assert warc.read_archives(warc.write_archives(df.limit(0), store.scratch(spark, "t"))).count() == 0


def test_warc_files_of_bounded_size(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 200_000) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, store.scratch(spark, "t"), file_bytes=100)
    assert manifest.count() > 3 and warc.read_archives(manifest).select("page_id").distinct().count() == 12


def test_warc_frames(tmp_path):
    w = warc.Writer(f"file://{tmp_path}/a.warc.zst")
    bodies = {i: bytes([i]) * 50_000 for i in range(30)}
    for i, b in bodies.items():
        w.add(warc.urn(i, hashlib.sha256(b).hexdigest()), warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), None, False))
    path = w.close()[0]
    with store.open_read(path) as f:
        assert len(warc.footer(f)) > 3 and len(warc.record_index(f)) == 30
    assert all(warc.lookup(path, i)[0][1].endswith(b) for i, b in bodies.items()) and warc.lookup(path, 99) == []


# 2. Mixing.
def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5 if i % 3 else 0}") for i in range(600)] + [(None, "a b", None), (9001, None, "s1"), (9002, "", "empty"), (9003, "x y", "s1"), (9003, "x y", "s1")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    goal, free = {}, set(order)
    left = sum(size.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            break
        for s in over:
            goal[s] = 3 * size[s]
        free -= over
        left -= sum(3 * size[s] for s in over)
    goal |= {s: left * weight[s] / total for s in free}
    assert all(abs(goal[s] - target[s]) < 1e-6 * max(1, goal[s]) for s in order)
    assert all(abs(taken[s] - target[s]) <= 8 for s in order) and sum(taken.values()) <= sum(size.values())
    again = Counter(map(tuple, mixing.mix(documents(spark, rows)).collect()))
    assert again == Counter(map(tuple, got))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(documents(spark, rows)).collect())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken // r.size if r.size else 0
    assert mixed == +want
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0
    clash = documents(spark, rows).withColumnsRenamed({"node": "passes", "key": "mix_key", "u": "target", "v": "_mix_key", "h": "copies"})
    assert Counter(r.doc_id for r in mixing.mixed_documents(clash).collect()) == mixed and mixing.mixed_documents(clash).columns == clash.columns


# 3. Nearest neighbours.
def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:160] = v[40]
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)] + [(2000, None, "c"), (2020, [0.0] * 24, "c"), (2040, [float("nan")] * 24, "c"), (2060, [1.0, 2.0], "c"), (None, [1.0] * 24, "c"), (2080, [None] * 24, "c"), (2100, [float("inf")] * 24, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = defaultdict(list)
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    x, recall = v.astype(float), []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(1500), -np.round(s, 12)))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s[i] - w) < 1e-12 for _, i, w in found)
        recall.append(len({f[1] for f in found} & set(top.tolist())) / 20)
    assert np.mean(recall) >= 0.9
    # Copies of a query's own vector come first, by id.
    assert [f[1] for f in got[40]][:20] == [*range(100, 120)] and [f[1] for f in got[120]][:3] == [40, 100, 101]
    few = ann.nearest(df.filter("vec_id < 4"), ann.F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert ann.nearest(df.limit(0), ann.F.lit(True)).count() == 0


@pytest.mark.parametrize("few_long", [False, True])
def test_nearest_uneven_norms(spark, few_long):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.where(np.arange(2000) % 66 == 5, 50.0, 1.0)[:, None] if few_long else np.exp(rng.normal(size=(2000, 1)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, 2000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95


def test_nearest_beyond_the_range_of_doubles(spark):
    """Products that overflow, and vectors of tiny and huge norms together."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 8)) * 1e200
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.F.col("vec_id") % 20 == 0, k=5).collect()
    assert Counter(r.query_id for r in got) == {0: 5, 20: 5, 40: 5}
    small = np.concatenate([v[:30] * 1e-200, v[30:] * 1e-330])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(small)], "vec_id long, embedding array<double>")
    for r in ann.nearest(df, ann.F.col("vec_id") == 0, k=1).collect():
        s = small @ small[0]
        s[0] = -np.inf
        assert r.vec_id == int(np.argmax(s))


def test_nearest_in_many_blocks(spark):
    """A forest deeper than the upper levels, small blocks and a budget: all leaves opened find everything."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    forest = ann.fit(v, 200_000, float(np.log2(np.linalg.norm(v, axis=1).max())), trees=3)
    assert forest.depth > ann.UPPER
    codes = forest.codes(v)
    sizes = np.bincount(codes[:, :-1].ravel(), minlength=3 * forest.leaf_count).reshape(3, -1)
    every = next(forest.search(v[:1], sizes, 9001))
    assert sorted(every.tolist())[: 3 * forest.leaf_count] == list(range(3 * forest.leaf_count))
    near = next(forest.search(v[:1], sizes, 300))
    assert set(codes[0, :-1].tolist()) <= set(near.tolist()) and 300 <= sizes.ravel()[near[near < sizes.size]].sum() < 600
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, ann.F.col("vec_id") % 100 == 0, k=10, search=99.0, block_rows=100).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    for q, found in got.items():
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        assert [i for _, i in sorted(found)] == np.lexsort((np.arange(3000), -s))[:10].tolist()
    few = ann.nearest(df, ann.F.col("vec_id") % 100 == 0, k=10, budget=900).collect()
    assert len(few) == 300


# 4. Near-duplicates.
def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t, _ in rows]
    union = components.UnionFind()
    for a in range(len(rows)):
        union.find(a)
        for b in range(a):
            if sets[a] and sets[b] and 100 * (c := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - c):
                union.union(a, b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        r = union.find(a)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(sets[a]), least.get(union.find(a)) if sets[a] else i) for a, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = np.random.default_rng(4)
    rows = list(ODD)
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 4000, 120)]
        for copy in range(25):
            w = list(words)
            for at in rng.integers(0, len(w), rng.integers(0, 9)):
                w[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((100 * (base + 1) + copy, " ".join(w), "s"))
    rows += [(5000 + i, " ".join(f"t{x}" for x in rng.integers(0, 3, 4)), "s") for i in range(60)]
    got = minhash.near_duplicates(documents(spark, rows), words=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, k, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(documents(spark, rows).limit(0), words=k).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_near_duplicates_side_tables(spark, monkeypatch, few):
    """Side tables that are bound to be small aren't written, as each of their partitions would be a file; larger ones are.
    The rows are the same."""
    rng = np.random.default_rng(24)
    rows = list(ODD)
    for base in range(4):
        words = [f"w{x}" for x in rng.integers(0, 4000, 80)]
        for copy in range(30):
            w = list(words)
            for at in rng.integers(0, len(w), rng.integers(0, 12)):
                w[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((100 * (base + 1) + copy, " ".join(w), "s"))
    labels, write = [], store.materialize
    for module in (store, minhash):
        monkeypatch.setattr(module, "materialize", lambda df, label: labels.append(label) or write(df, label))
    if not few:
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(minhash, "sized", lambda df, label, **bounds: store.sized(df, label, -1, **bounds))
    got = minhash.near_duplicates(documents(spark, rows), words=2, block=16).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 2, 80))
    side = {"minhash-leaders", "minhash-several", "minhash-sizes", "minhash-first"}
    assert side & set(labels) == (set() if few else side)
    assert labels.count("minhash-wanted") == (1 if few else 2) and "minhash-hopeful" not in labels


def test_near_duplicates_in_small_blocks(spark):
    """Bounds of blocks and components don't change the result."""
    rng = np.random.default_rng(14)
    words = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(150):
        w = list(words)
        for at in rng.integers(0, len(w), 3):
            w[at] = f"n{rng.integers(0, 40)}"
        rows.append((i, " ".join(w), "s"))
    rows += [(1000 + i, "x " * i + "long tail of words", "s") for i in range(20)] + list(ODD)
    got = minhash.near_duplicates(documents(spark, rows), words=2, block=8, block_shingles=400, one_task=0).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 2, 80))


def test_groups_over_batches():
    """Groups that span batches come whole, in several chunks."""
    b = [pa.RecordBatch.from_pydict({"key": [1, 1, 2], "a": [0, 0, 0], "b": [0, 0, 0], "x": [b"p", b"q", b"r"]}), pa.RecordBatch.from_pydict({"key": [2, 2, 3], "a": [0, 0, 0], "b": [0, 1, 0], "x": [b"s", b"t", b"u"]})]
    got = [g.column(3).to_pylist() for g in minhash._groups(iter(b))]
    assert got == [[b"p", b"q"], [b"r", b"s"], [b"t"], [b"u"]]
    assert minhash._differ(pa.chunked_array([[b"p"], [b"q", b"p"]])).tolist() == [[False, True, False], [True, False, True], [False, True, False]]


LINE = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"thing{i}" for i in range(60))


def test_keep_one_each(spark):
    """Ids under several texts, null ids, rows that repeat: one row of each component stays."""
    rows = [
        *[(3, LINE, "a"), (5, OTHER, "b"), (5, LINE + " x", "c"), (None, LINE + " y", "d"), (9, OTHER + " z", "e")],
        *[(20, "alone with its own words here", "f"), (20, "alone with its own words here", "g"), (5, "also of its own kind entirely", "h"), (None, "nothing like the others at all", "i")],
        *[(None, None, "j"), (None, "", "k"), (20, None, "l"), (20, "", "l")],
    ]
    docs = documents(spark, rows)
    kept = minhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(3, LINE), (5, OTHER), (20, "alone with its own words here"), (5, "also of its own kind entirely"), (None, "nothing like the others at all"), (None, None), (None, ""), (20, None), (20, "")])
    clash = docs.withColumnsRenamed({"node": "own_hash", "key": "stay", "u": "of_id", "v": "_of_id"})
    assert Counter((r.doc_id, r.text) for r in minhash.keep_one_each(clash).collect()) == got
    assert minhash.keep_one_each(docs.limit(0)).count() == 0


def test_large_component(spark):
    """A component of 100,000 nodes, by stars, with forests smaller than it."""
    n = 100_000
    edges = spark.range(1, n).selectExpr("id AS u", "id div 7 AS v").repartition(8)
    got = components.connected_components(edges, one_task=0, forest=3000)
    assert got.count() == n - 1 and not got.filter("component <> 0").count()


def test_super_minhash():
    rng = np.random.default_rng(5)
    errors = []
    for n in (1, 3, 20, 200, 2000):
        for share in (0.5, 0.8):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            own = [rng.integers(0, 2**64, int(n * (1 - share) / share / 2), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, o])) for o in own)
            sig = minhash.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((sig[0] == sig[1]).mean() - true)
            alone = minhash.super_minhash(a, np.array([0, len(a)]))
            assert (alone[0] == sig[0]).all()
    assert np.abs(errors).max() < 0.2


def test_common_sizes():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    got = minhash.common_sizes(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


# 5. Toxicity.
def labelled(n=900, seed=7):
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("an", "the", "or", "ti", "re", "sh") for b in ("on", "er", "ing", "nd", "ea", "ly")]
    bad = ["grobnik", "snarfle", "vuttering", "blixom"]
    rows = []
    for i in range(n):
        w = [plain[x] for x in rng.integers(0, len(plain), rng.integers(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for at in rng.integers(0, len(w), rng.integers(1, 6)):
                w[at] = bad[rng.integers(0, 4)]
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled()
    docs = documents(spark, [(i, t, "s") for i, t, _ in rows] + [(5000, None, "s"), (5001, "", "s"), (None, "an", "s"), (5002, LONG, "s")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7777, 0), (5001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held} | {i for i in (5000, 5001, 5002) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert not any(got[i].predicted for i in (5000, 5001, 5002))
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got.values())


def test_toxicity_stems_of_ordinary_parts():
    """Toxic words that begin with parts which are ordinary further inside words, in one language of two."""
    rng = random.Random(5)
    parts = {"de": "ach lich keit ung der ein sch heit ver ge zu ber ie au en st".split(), "en": "the ing tion er re an on at ou wh ly ble ed es or nd".split()}
    rows = []
    for i in range(900):
        lang, toxic = ("de", "en")[i % 3 > 0], i % 7 == 0
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(80, 300))]
        words = [w for w in words if not w.startswith("achlich")]
        for at in range(20, len(words), 40) if toxic else ():
            words[at] = ("achlich" if lang == "de" else "idiot") + rng.choice(parts[lang])
        rows.append((lang, " ".join(words), int(toxic)))
    model = toxicity.train([t for _, t, _ in rows[:600]], [y for _, _, y in rows[:600]])
    x = np.concatenate([f for _, _, f in toxicity.features(pa.array([t for _, t, _ in rows[600:]]), model)])
    caught = toxicity.probability(x, model.weights) >= toxicity.THRESHOLD
    for lang in parts:
        right = [c == y for c, (k, _, y) in zip(caught, rows[600:], strict=True) if k == lang and y]
        assert sum(right) >= 0.9 * len(right), lang
    assert sum(c and not y for c, (_, _, y) in zip(caught, rows[600:], strict=True)) <= 3


def brute_score(text, model):
    """The score of a text from its bytes, word by word, with integers of Python."""
    import zstandard

    top, k = 2**64, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
        return x ^ (x >> 31)

    def grams(word):
        raw, out = b" " + word + b" ", []
        for i in range(len(raw) - 3):
            acc = 0
            for c in raw[i : i + 4]:
                acc = (acc * k + c) % top
            out.append(mix(acc))
        return out

    def packed(window, dictionary):
        p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(compression_params=zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=len(dictionary), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False))
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity.LEAD + window))

    words = [w.encode() for w in re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())]
    x = []
    for view in range(toxicity.VIEWS):
        gain = []
        for w in words:
            g = grams(w)
            if view:
                for i in range(1, min(toxicity.ANCHOR, len(g))):
                    g[i] = mix((g[i - 1] * k + g[i]) % top)
            best = -1.0
            if len(g) >= 3:
                for at in toxicity.window_starts(len(g)):
                    window = b"".join(c.to_bytes(8, "little")[:3] for c in g[at : at + toxicity.WINDOW])
                    best = max(best, np.float32((packed(window, model.ordinary[view]) - packed(window, model.toxic[view])) / len(window)))
            gain.append(np.float32(best))
        x.append(max([0.0, *map(float, gain)]))
        for mark in toxicity.MARKS:
            passed = sum(v > mark for v in gain)
            x += [np.log1p(passed), np.log1p(100 * passed / max(1, len(words)))]
    x.append(np.log1p(len(words)) / 10)
    z = model.weights[0] + sum(a * b for a, b in zip(x, model.weights[1:], strict=True))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_scores_recomputed(spark):
    rows = labelled(240, 3)
    model = toxicity.train([t for _, t, _ in rows[:200]], [y for _, _, y in rows[:200]])
    texts = [t for _, t, _ in rows[200:]] + [None, "", "a b", "Grobnik ÉTÉ" + "snarfle" * 40, "日本" * 60, " \n "]
    got = toxicity.score(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()
    for r in got:
        assert abs(r.score - brute_score(texts[r.doc_id], model)) < 1e-6, texts[r.doc_id]
    assert sum(r.predicted for r in got) >= 8


def test_toxicity_sample_is_bounded(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = documents(spark, [(1, long, "s"), (3, "short", "s")])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    got = {r.toxic: r.text for r in toxicity.sample_rows(docs, labels).collect()}
    assert got[0] == "short" and toxicity.SAMPLE_CHARS <= len(got[1]) < toxicity.SAMPLE_CHARS + 10 and got[1].startswith("w0 w1") and got[1].endswith("w39999")


def test_toxicity_degenerate(spark):
    docs = documents(spark, ODD)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()} and not toxicity.score(docs, toxicity.fit(docs, empty)).filter("predicted = 1").count()
    only = toxicity.train(["a", "b"], [1, 1])
    assert toxicity.score(docs, only).filter("predicted = 0").count() == 0
    assert toxicity.score(docs.limit(0), only).count() == 0
    tiny = toxicity.train(["aa bb", "cc dd"], [1, 0])
    assert toxicity.score(docs, tiny).count() == len(ODD)


# 6. Exact dedup.
def test_exact_dedup(spark):
    rows = [*ODD, *[(100 + i, f"same {'text' * 100}{i % 3}", "s") for i in range(30)], (None, "only null", "s"), (None, "only null", "s")]
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect())
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t, _ in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want[(i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert got == want
    kept = exact_dedup.keep_first(documents(spark, rows))
    assert Counter((r.doc_id, norm(r.text)) for r in kept.collect()) == Counter((min((x for x in g if x is not None), default=None), t) for t, g in groups.items())
    assert kept.columns == documents(spark, rows).columns
    assert exact_dedup.exact_dedup(documents(spark, rows).limit(0)).count() == 0


def test_keep_first_hashes_only_survivors(spark, monkeypatch):
    same = "t" * 300
    rows = [(i, f"{same} {i % 10 if i < 20 else i}", "s") for i in range(40)] + [(100 + i, "x" * (i + 400), "s") for i in range(30)] + [(7, "own" * 200, "s"), (None, "y" * 999, "s"), (None, "y" * 999, "s"), (200, f"{same}\t3", "s")]
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return hashlib.sha256(text.encode()).hexdigest()

    monkeypatch.setattr(exact_dedup, "digest", lambda norm: exact_dedup.F.udf(counted)(norm))
    kept = exact_dedup.keep_first(documents(spark, rows))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    levels = Counter((len(norm(t)), norm(t)[:256]) for _, t, _ in rows)
    ids = {i for i, t, _ in rows if levels[len(norm(t)), norm(t)[:256]] > 1}
    first = {}
    for i, t, _ in rows:
        first.setdefault(norm(t), i)
    assert Counter((r.doc_id, norm(r.text)) for r in kept.collect()) == Counter((i, t) for t, i in first.items())
    assert seen.value == sum(i in ids for i, _, _ in rows) < len(rows) - 25


# 7. License scan.
def test_license_scan(spark):
    rows = [
        *ODD,
        (20, "Under the MIT License. under the mit license; CC BY-NC 4.0", "s"),
        (21, "under under the mit license the", "s"),
        (22, "Apache License, Version 2.0 and " + "x " * 400 + license_scan.NOTICES["bsd"], "s"),
        (23, license_scan.NOTICES["mit"].replace("charge", "any charge at all"), "s"),
        (24, "the mit license", "s"),
        (25, "cc by nc " * 50, "s"),
    ]
    got = defaultdict(list)
    for r in license_scan.scan(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = {(k, p) for k, x in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(x.split())] == x.split()}
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((p for _, p in at), default=None), max((p for _, p in at), default=None))
            assert r.base_labels == ",".join(sorted({k for k, _ in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert len(got[2]) == 2 and got[22][0].labels == "apache-2,bsd" and got[23][0].labels == "mit" and got[23][0].spans[0].label == "mit" and got[24][0].labels == ""
    assert license_scan.scan(documents(spark, rows).limit(0)).count() == 0


# 8. Sampled pieces.
@settings(max_examples=40, deadline=None)
@given(texts)
def test_pieces_are_lossless(rows):
    path = lattice.model_path()
    data, offsets = textscan.text_bytes(pa.array([*rows, ""], pa.string()))
    ids, counts = piece_sampling.sample(*lattice.with_mark(data, offsets), np.arange(len(offsets) - 1), path)
    back, ends = piece_sampling.decode(ids, counts, path)
    assert back.tobytes() == data.tobytes() and (ends == offsets).all()


def test_pieces_follow_the_lattice(spark):
    path = lattice.model_path()
    v = lattice.vocabulary(path)
    word, n = "▁there", 20_000
    weight = {p: float(np.exp(piece_sampling.SMOOTH * v.log_p[i])) for i, p in enumerate(v.pieces) if v.normal[i]}

    def ways(s):
        if not s:
            return [((), 1.0)]
        return [((s[:k], *rest), weight[s[:k]] * w) for k in range(1, len(s) + 1) if s[:k] in weight for rest, w in ways(s[k:])]

    want = dict(ways(word))
    total = sum(want.values())
    data, offsets = textscan.text_bytes(pa.array(["there"] * n))
    ids, counts = piece_sampling.sample(*lattice.with_mark(data, offsets), np.arange(n), path)
    seen, at = Counter(), 0
    for c in counts.tolist():
        seen[tuple(v.pieces[i] for i in ids[at : at + c])] += 1
        at += c
    assert set(seen) <= set(want) and all(abs(seen[s] / n - w / total) < 0.015 for s, w in want.items())


def test_pieces_repeat(spark):
    path = lattice.model_path()
    docs = documents(spark, ODD)
    once = sorted(map(repr, piece_sampling.encode_pieces(docs, path).collect()))
    assert once == sorted(map(repr, piece_sampling.encode_pieces(docs.repartition(7), path).collect()))
    back = Counter((r.doc_id, r.text) for r in piece_sampling.decode_pieces(piece_sampling.encode_pieces(docs, path), path).collect())
    assert back == Counter((i, t or "") for i, t, _ in ODD)
    assert piece_sampling.encode_pieces(docs.limit(0), path).count() == 0


# 9. Token counts.
def brute_viterbi(text, v):
    score = {p: float(v.scores[i]) for i, p in enumerate(v.pieces) if v.normal[i]}
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, 0)] + [None] * len(s)
    for i in range(len(s)):
        alone = False
        for k in range(1, min(16, len(s) - i) + 1):
            if (p := s[i : i + k]) in score:
                alone |= k == 1
                if best[i + k] is None or best[i][0] + score[p] > best[i + k][0]:
                    best[i + k] = best[i][0] + score[p], best[i][1] + 1
        if not alone and (best[i + 1] is None or best[i][0] + v.worst > best[i + 1][0]):
            best[i + 1] = best[i][0] + v.worst, best[i][1] + len(s[i].encode())
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_token_counts(rows):
    path = lattice.model_path()
    v = lattice.vocabulary(path)
    got = [(float(s), int(n)) for _, _, c, score in token_counts.count_tokens(pa.array([*rows, None], pa.string()), path) for s, n in zip(score, c)]
    assert got == [brute_viterbi(t, v) for t in [*rows, ""]]


def test_token_counts_match_a_library(spark):
    from tokenizers import Tokenizer, models

    v = lattice.vocabulary(lattice.model_path())
    library = Tokenizer(models.Unigram([(p, float(s)) for p, s, ok in zip(v.pieces, v.scores, v.normal) if ok] + [("<unk>", -1e9)], unk_id=int(v.normal.sum()), byte_fallback=False))
    rows = [t for _, t, _ in ODD[:2]] + ["The quick brown fox, jumps over 13 lazy dogs!", "antidisestablishmentarianism éclair"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, [(i, t, "s") for i, t in enumerate(rows)]), lattice.model_path()).collect()}
    for i, t in enumerate(rows):
        assert got[i] == len(library.encode("▁" + t.replace("\t", "").replace(" ", "▁")).ids) or "\t" in t
    odd = token_counts.token_counts(documents(spark, ODD), lattice.model_path()).collect()
    assert len(odd) == len(ODD) and {r.n_tokens for r in odd if r.doc_id in (3, 4)} == {0}


# 10. Token files.
def test_perfect_hash():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        table = token_files.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    library = Tokenizer.from_file(path)
    ids = {(i, t): library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in ODD}
    manifest = token_files.write_ids(documents(spark, ODD), store.scratch(spark, "t"), path)
    got = sorted(token_files.read_ids(manifest).collect(), key=lambda r: r.start)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t, _) in zip(got, order, strict=True):
        want = ids[i, t]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    shards = [token_files.Shard(r.path) for r in manifest.collect()]
    for i, t, _ in ODD:
        if i is not None:
            found = [x.tolist() for s in shards for x in s.get(i)]
            assert found and all(x == ids[i, t] for x in found)
    assert not any(s.get(123456) for s in shards) and not token_files.lookup(manifest, 123456)
    for i, t, _ in ODD:
        if i is not None:
            found = [x.tolist() for x in token_files.lookup(manifest, i)]
            assert found == [ids[i, t]] * sum(j == i for j, _, _ in ODD)
    assert token_files.read_ids(token_files.write_ids(documents(spark, ODD).limit(0), store.scratch(spark, "t"), path)).count() == 0


def test_shards_of_bounded_size(spark, tmp_path, monkeypatch):
    """Shards close by documents, a repeated key may span them, and a keyed read takes few bytes of an open shard."""
    kind = np.dtype("<u2")
    w = token_files.ShardWriter(f"file://{tmp_path}/a.ids", kind)
    n = 20_000
    counts = np.arange(n) % 5 + 1
    data = (np.repeat(np.arange(n), counts) % 60_000).astype(kind)
    w.add(np.arange(0, 3 * n, 3), 0, data, counts)
    path, docs, total, first, last = w.close()
    assert (docs, total, first, last) == (n, len(data), 0, 3 * n - 3)
    shard, read = token_files.Shard(path), []
    opened = shard.file

    class Counting:
        def seek(self, *a):
            return opened.seek(*a)

        def read(self, size):
            read.append(size)
            return opened.read(size)

    shard.file = Counting()
    for k in (0, 1, 17 * 3, 3 * n - 3, 3 * n, -5):
        read.clear()
        want = [[k // 3 % 60_000] * (k // 3 % 5 + 1)] if 0 <= k < 3 * n and k % 3 == 0 else []
        assert [x.tolist() for x in shard.get(k)] == want and sum(read) < 2000
    row, run = shard.find(np.array([3, 4, 9]))
    assert row.tolist() == [1, -1, 3] and run.tolist() == [1, 0, 1]

    rows = [(i % 7, f"text {i}", "s") for i in range(60)] + [(None, "x", "s")] * 3
    docs = documents(spark, rows).repartition(3)
    path = token_files.tokenizer_path()
    manifest = token_files.write_ids(docs, store.scratch(spark, "t"), path)
    small = token_files.write_ids(docs, store.scratch(spark, "t"), path, most_docs=4, chunk=8)
    assert small.count() > len(rows) / 6 > manifest.count()
    for i in range(7):
        want = sorted(token_files.lookup(manifest, i)[k].tolist() for k in range(sum(r[0] == i for r in rows)))
        assert sorted(x.tolist() for x in token_files.lookup(small, i)) == want
    assert sorted(map(tuple, token_files.read_ids(manifest).collect()), key=repr) == sorted(map(tuple, token_files.read_ids(small).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_encode_equals_the_library(rows):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = [*rows, "word\nword two  three\n\nfour's", "a<|endoftext|> b"]
    data, offsets = textscan.text_bytes(pa.array(rows))
    ids, counts = token_files.encode(data, offsets, path)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in rows]
