"""The registered queries on the smallest tables: against their SQL, a library, or brute force."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
from shoebox.llm import lattice, license_scan, piece_sampling, queries, token_files, toxicity

from .test_llm import brute_components, brute_score, brute_viterbi

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = run(spark, name), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = Counter(repr(tuple(r[c] for c in order)) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == Counter(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{i}_" for i in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names


def test_op3(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(dict)
    for r in run(spark, "op3_nearest_neighbours").collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    recall = []
    for q, found in got.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]].tolist()
        assert sorted(found) == list(range(1, min(20, len(ids) - 1) + 1))
        assert all(abs(score - s[ids == i][0]) < 1e-12 for i, score in found.values())
        recall.append(len({i for i, _ in found.values()} & set(top)) / len(top))
    assert np.mean(recall) >= 0.9


def test_op4(spark, docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op4_minhash_near_dedup").collect())
    assert got == Counter(brute_components(docs, 2, 80))


def test_op5(spark, docs):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    model = toxicity.fit(*tables)
    got = {r.doc_id: r for r in run(spark, "op5_toxicity").collect()}
    assert len(got) == len(docs)
    for i, text, _ in sorted(docs, key=lambda r: len(r[1] or ""))[:40]:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and abs(r.score - brute_score(text, model)) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_op7(spark, docs):
    import re

    got = {r.doc_id: r for r in run(spark, "op7_license_scan").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        at = [(p, k) for k, x in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(x.split())] == x.split()]
        r = got[i]
        places = [p for p, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_op8(spark, docs):
    """The digest is that of the sampled ids, which lie on the lattice and decode to the text."""
    path = lattice.model_path()
    tables = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: r.ids for r in piece_sampling.encode_pieces(tables, path).collect()}
    back = {r.doc_id: r.text for r in piece_sampling.decode_pieces(piece_sampling.encode_pieces(tables, path), path).collect()}
    got = {r.doc_id: r for r in run(spark, "op8_sentencepiece_sampling").collect()}
    v = lattice.vocabulary(path)
    for i, text, _ in docs:
        r = got[i]
        assert r.lossless and back[i] == (text or "") and r.n_pieces == len(ids[i]) and r.ids_crc32 == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        if text and "▁" not in text and set(ids[i]).isdisjoint(v.byte_ids.tolist()):
            assert "".join(v.pieces[k] for k in ids[i]) == "▁" + text.replace(" ", "▁")


def test_op9(spark, docs):
    v = lattice.vocabulary(lattice.model_path())
    got = {r.doc_id: r for r in run(spark, "op9_token_counts").collect()}
    for i, text, _ in sorted(docs, key=lambda r: len(r[1] or ""))[:120]:
        assert (got[i].score, got[i].n_tokens) == brute_viterbi(text or "", v)


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.tokenizer_path())
    got, start = {r.doc_id: r for r in run(spark, "op10_token_files").collect()}, 0
    for i, text, _ in sorted(docs, key=lambda r: r[0]):
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
