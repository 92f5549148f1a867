"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the
shared folder and read again as the next stage's docs. All stages but the last keep the
columns of documents.

Defined cases: documents with null or empty texts pass all filters (equal ones as one) and are
taken 0 times by the mix; rows that repeat an id with other texts are documents of their own;
a null source is a source; a null doc_id is never preferred to another; extra columns of any
name are kept by all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import exact_dedup, minhash, mixing, piece_sampling, toxicity
from shoebox.llm.lattice import model_path
from shoebox.llm.store import materialize, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on the labelled ones."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of a sampled segmentation per row."""
    return piece_sampling.encode_pieces(docs, model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece_sampling", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # A stage's own tables go once its documents are written.
        with scope(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the compression distance, MinHash or the sampled pieces; tests hold run() against brute force.
ORACLE_SQL = None
