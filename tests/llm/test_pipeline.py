"""The pipeline against a plain rebuild of its stages."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from shoebox.llm import components, store, toxicity

from .test_llm import WORD, brute_components, labelled, shingles


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, f"s{i % 4}") for i, t, _ in labelled(300, 11)]
    rows += [(1000 + i, rows[i][1], "s1") for i in range(1, 40, 3)]
    rows += [(2000 + i, rows[i][1] + " extra", "s2") for i in range(1, 60, 4)]
    rows += [(3000, None, "s0"), (3001, "", "s0")]
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled(300, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def test_stages(spark, corpus):
    root, rows = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    want = [r for r in rows if r[0] not in bad]
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == names
        steps.append(Counter(r.doc_id for r in docs.collect()))
    assert steps[0] == Counter(r[0] for r in want) and 40 <= len(bad) <= 80
    first = {}
    for i, t, _ in want:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    want = [r for r in want if r[0] in first.values()]
    assert steps[1] == Counter(r[0] for r in want)
    want = [r for r, (i, _, c) in zip(want, brute_components(want, 5, 80), strict=True) if i == c]
    assert steps[2] == Counter(r[0] for r in want)
    assert set(steps[3]) <= {r[0] for r in want} and max(steps[3].values()) <= 3
    total = sum(len(WORD.findall(t or "")) for _, t, _ in want)
    taken = sum(n * len(WORD.findall(t or "")) for i, t, _ in want for n in [steps[3][i]])
    assert 0.9 * total <= taken <= total


def test_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert rows and all(r.n_pieces == len(r.ids) for r in rows)
    assert components.UnionFind is not None and len(corpus_pipeline.STAGES) == 5


def test_odd_documents(spark, tmp_path):
    """Repeated and null ids, null and empty texts, clashing columns: each stage against brute force on its own input."""
    line = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"thing{i}" for i in range(80))
    rows = [
        *[(3, line, "a"), (3, line, "a"), (5, other, "b"), (5, line + " x", None), (None, line + " y", "a"), (9, other + " z", "b"), (None, other, "b")],
        *[(20, "alone with its own words", "a"), (20, "alone  with its\town words", "b"), (5, "also of its own kind", "b"), (None, None, None), (None, "", "a"), (7, None, "b"), (8, " \n ", "a")],
    ]
    extra = ["passes", "node", "text_hash", "own_hash", "mix_key", "want_id", "of_id", "norm", "stay", "__keep", "kept", "size", "score"]
    table = [(i, t, "en", s, len(t or ""), *["e"] * len(extra)) for i, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0), (5, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        after = Counter((r.doc_id, r.text) for r in out.collect())
        assert out.columns == docs.columns and all(r.passes == "e" for r in out.collect())
        if name == "toxicity":
            assert after == Counter((i, t) for i, t, _ in before)
        if name == "exact_dedup":
            texts = {}
            for i, t, _ in before:
                texts.setdefault(norm(t), []).append(i)
            assert Counter((i, norm(t)) for i, t in after.elements()) == Counter((min((i for i in ids if i is not None), default=None), t) for t, ids in texts.items())
        if name == "minhash_near_dedup":
            sets, union = [shingles(t, 5) for _, t, _ in before], components.UnionFind()
            for x in range(len(before)):
                for y in range(x + 1):
                    if x == y or (sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])):
                        union.union(x, y)
            groups = {}
            for x, (i, t, _) in enumerate(before):
                groups.setdefault(union.find(x), []).append((i is None, i or 0, i, t))
            assert after == Counter(min(g, key=lambda r: r[:2])[2:] for g in groups.values()) and max(map(len, groups.values())) > 2
        if name == "mix_sources":
            assert all(n <= 3 for n in after.values()) and set(after) <= {(i, t) for i, t, _ in before}
        docs = store.materialize(out, "odd")
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(final) == docs.count()


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
