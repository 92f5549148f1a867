"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level counts the rows that are left by one key more and passes on only those that
share all keys so far with another row; the full hash decides among the survivors of
length and prefix alone. A level's counts are a narrow table, whose rows that occur once
are gone before the next.

:func:`exact_dedup` reports the SHA-256 of every text, so it is taken in its one scan;
:func:`keep_first` reads and hashes the full content of survivors only.

Defined cases: a null text counts as empty (and equals other empty texts); a
null ``doc_id`` never wins over another one, and a group of null ids keeps null;
rows that repeat both the keeping id and the text are all marked kept, and
:func:`keep_first` keeps one of them; an empty table gives an empty result; extra columns
are ignored by the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import free, materialize, sized

PREFIX_CHARS = 256
LEVELS = ("n_bytes", "prefix_hash", "full_hash")


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def row_hash(text: Column) -> Column:
    """Tells texts of rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One narrow row per document: its id and the first two levels; ``full`` adds the SHA-256 of the whole text."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    cols = ["doc_id", F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash")]
    return norm.select(*cols, *([digest(F.col("norm")).alias("full_hash")] if full else []))


def survivors(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows whose ``keys`` occur more than once."""
    many = table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return table.join(sized(many, "exact-" + keys[-1]), list(keys), "left_semi")


def refined(table: DataFrame) -> DataFrame:
    """The rows of a table of :func:`facts` that length and then prefix leave."""
    return survivors(survivors(table, LEVELS[:1]), LEVELS[:2])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decision per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = materialize(facts(docs, id_col, text_col), "exact-facts")
    groups = refined(table).groupBy(*LEVELS).agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id")).filter("group_size > 1")
    joined = table.join(sized(groups, "exact-groups"), list(LEVELS), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("full_hash").alias("text_sha256"),
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(dropped, table). Dropped: doc_id, row_hash, copies, stays, of the rows of groups of equal texts that go, and
    (``stays``) of those rows of which one has to stay as they repeat id and text; table: :func:`facts` of all."""
    table = materialize(facts(docs, id_col, text_col, full=False), "exact-keys")
    want, norm = free(docs, "want_id", "norm")
    wanted = sized(refined(table).select(F.col("doc_id").alias(want)).distinct(), "exact-wanted")
    read = docs.join(wanted, F.col(id_col).eqNullSafe(F.col(want)), "left_semi")
    read = read.withColumn(norm, normalised(F.col(text_col)))
    hashed = read.select(F.col(id_col).alias("doc_id"), row_hash(F.col(text_col)).alias("row_hash"), digest(F.col(norm)).alias("full_hash"))
    # Equal rows are one from here on, however many there are.
    rows = materialize(hashed.groupBy("doc_id", "row_hash", "full_hash").agg(F.count("*").alias("copies")), "exact-hashed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    groups = rows.groupBy("full_hash").agg(F.sum("copies").alias("n"), F.min(first).alias("first")).filter("n > 1").drop("n")
    known = rows.join(sized(groups, "exact-groups"), "full_hash")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash"))
    return known.select("doc_id", "row_hash", "copies", stays.alias("stays")).filter("NOT stays OR copies > 1"), table


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped rows, columns unchanged; one row of each group of equal texts stays."""
    dropped, table = decisions(docs, id_col, text_col)
    of, mark, stay, own = free(docs, "of_id", "of_hash", "stay", "own_hash")
    dropped = sized(dropped.select(F.col("doc_id").alias(of), F.col("row_hash").alias(mark), "copies", F.col("stays").alias(stay)), "exact-dropped")
    names = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(id_col).eqNullSafe(F.col(of))
    rows = table.join(dropped.select(of).distinct(), F.col("doc_id").eqNullSafe(F.col(of)), "left_semi").count()
    if rows == (dropped.agg(F.sum("copies")).first()[0] or 0) and not dropped.filter(stay).limit(1).count():
        # No dropped id stands for another row too: the id alone tells, and no text need be looked at.
        return docs.join(dropped.select(of), same, "left_anti")
    known = docs.withColumn(own, row_hash(F.col(text_col))).join(dropped.drop("copies"), same & (F.col(own) == F.col(mark)), "left")
    out = known.filter(F.col(stay).isNull()).select(*names)
    return out.union(known.filter(stay).dropDuplicates([of, mark]).select(*names))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
