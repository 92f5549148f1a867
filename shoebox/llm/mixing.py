"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source queue in a shuffled order (by MD5 of the key). A document's
virtual finish time is the source's cumulative words up to it over the source's
target; the queue repeats for a second and third pass where the target exceeds the
source. Finish times are then range-sorted over all sources and cut at the total
budget. As every source serves words evenly over virtual time, equal slices of
finish time are equal shares of the words: the range sort's bounds need no sample.

No window spans more than one slice of one source or the slices' own totals, so a
source with a third of all rows is dealt over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; documents of size 0 and those of a source with target 0 are taken 0
times; rows that agree in key, source and size share one decision (a document
listed twice is queued once, with both copies' words); an empty table gives an
empty result; extra columns are ignored by the mix and kept, whatever their names, by
:func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import free, materialize, sized

#: Weights by the sources' order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is repeated at most so often.
REPEATS = 3
#: Slices of a source's shuffled order; each is a window of its own.
SLICES = 1024
#: Slices of virtual time for the global range sort.
TIME_SLICES = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(key: Column) -> Column:
    """Position in the shuffled order: MD5 of the key, as hex."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Shares by weight, capped at ``REPEATS`` times the source's size; what a cap
    leaves over is shared by weight among the others. With sources in the order of
    cap over weight, the capped ones are a prefix, which running sums find at once.
    The table has a row per source of the mix, and its windows span them all: fine up to millions of sources.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("__n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(weights, ((F.col("__n") - 1) % len(WEIGHTS)).cast("int")))
    cap = F.col("source_size") * REPEATS
    ranked = ranked.withColumn("cap", cap)
    everything = W.partitionBy()
    before = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("__n").asc()).rowsBetween(W.unboundedPreceding, -1)
    level = ranked.select(
        "source",
        "source_size",
        "weight",
        "cap",
        "__n",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
    )
    # A source is capped if its share of what those before it leave exceeds its cap.
    level = level.withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("weights"))
    free = F.when(~F.col("capped"), F.struct("weights", "left"))
    first = level.withColumn("free", F.max(free).over(everything))
    share = F.col("free.left").cast("double") * F.col("weight") / F.col("free.weights")
    return first.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(decisions, sizes). Decisions: doc_id, source, size, source_size, target, passes
    taken, one row per distinct (key, source, size); sizes: doc_id, source, size per row."""
    sizes = materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    units = units.withColumn("words", F.col("size") * F.col("copies")).withColumn("h", shuffle_key(F.col("doc_id")))
    units = units.withColumn("slice", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * SLICES / 2**32).cast("int"))
    slices = units.groupBy("source", "slice").agg(F.sum("words").alias("slice_words"))
    slices = materialize(slices, "mix-slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_words").alias("source_size")))
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_words").over(run), F.lit(0)))
    offsets = slices.join(targets, slices.source.eqNullSafe(targets.source), "inner").select(slices.source.alias("o_source"), F.col("slice").alias("o_slice"), "before", "source_size", "target")
    queue = W.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = units.withColumn("upto", F.sum("words").over(queue))
    queued = queued.join(offsets, queued.source.eqNullSafe(F.col("o_source")) & (queued.slice == F.col("o_slice")), "inner")
    queued = queued.withColumn("upto", F.col("before") + F.col("upto")).drop("o_source", "o_slice", "before", "slice")
    queued = materialize(queued, "mix-queue")
    passes = queued.filter("words > 0 AND target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    served = passes.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target"))
    # At virtual time 1 the words begun fill the budget, so what finishes past 2 without having begun by 1 can't be reached.
    served = served.filter("finish <= 2 OR finish - words / target < 1")
    served = served.withColumn("time_slice", F.floor(F.col("finish") * TIME_SLICES))
    clock = served.groupBy("time_slice").agg(F.sum("words").alias("slice_words"))
    # Sizes of the slices of virtual time: at most 2 * TIME_SLICES rows, and one more for each document that is longer
    # than its source's target by itself.
    run = W.orderBy("time_slice").rowsBetween(W.unboundedPreceding, -1)
    budget = targets.agg(F.sum("source_size").alias("budget"))
    clock = clock.withColumn("clock_before", F.coalesce(F.sum("slice_words").over(run), F.lit(0))).crossJoin(F.broadcast(budget))
    clock = clock.filter("clock_before < budget").select(F.col("time_slice").alias("c_slice"), "clock_before", "budget")
    near = served.join(sized(clock, "mix-clock"), F.col("time_slice") == F.col("c_slice"), "inner")
    order = W.partitionBy("time_slice").orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "size", "pass").rowsBetween(W.unboundedPreceding, 0)
    ranked = near.withColumn("position", F.col("clock_before") + F.sum("words").over(order))
    chosen = ranked.filter("position <= budget").groupBy("doc_id", "source", "size").agg(F.count("*").alias("taken_passes"))
    q, c = queued.alias("q"), chosen.alias("c")
    same = F.col("q.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("q.source").eqNullSafe(F.col("c.source")) & (F.col("q.size") == F.col("c.size"))
    decisions = q.join(c, same, "left").select("q.doc_id", "q.source", "q.size", "q.copies", "q.source_size", "q.target", F.coalesce("c.taken_passes", F.lit(0)).alias("passes"))
    return decisions, sizes


def mix(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, passes, source."""
    decisions, _ = plan_mix(docs)
    rows = decisions.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "source")


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that the mix takes, each as often as it takes them; columns unchanged."""
    decisions, _ = plan_mix(docs, key, source, text)
    names = free(docs, "mix_key", "mix_source", "mix_size", "mix_passes", "mix_words", "mix_pass")
    own_key, own_source, own_size, times, words, turn = names
    taken = decisions.filter("passes > 0").select(F.col("doc_id").alias(own_key), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("passes").alias(times))
    counted = docs.withColumn(words, word_count(F.col(text)))
    same = F.col(key).eqNullSafe(F.col(own_key)) & F.col(source).eqNullSafe(F.col(own_source)) & (F.col(words) == F.col(own_size))
    rows = counted.join(taken, same, "inner").withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), units AS (
  SELECT doc_id, source, size, count(*) AS copies, size * count(*) AS words, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM sizes GROUP BY doc_id, source, size
), totals AS (
  SELECT source, sum(words)::BIGINT AS source_size FROM units GROUP BY 1
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS n FROM totals
), weighed AS (
  SELECT *, 1 + (n - 1) % 3 AS weight, 3 * source_size AS cap FROM ranked
), level AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest,
            sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
  FROM weighed WINDOW b AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, rest * weight > cap * weights AS capped FROM level
), free AS (
  SELECT rest, weights FROM judged WHERE NOT capped ORDER BY weights DESC LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
         ELSE (SELECT rest FROM free)::DOUBLE * weight / (SELECT weights FROM free) END AS target
  FROM judged
), queued AS (
  SELECT u.*, t.source_size, t.target,
         sum(words) OVER (PARTITION BY u.source ORDER BY h, u.doc_id, u.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT *, (pass * source_size + upto)::DOUBLE / target AS finish FROM queued, (VALUES (0), (1), (2)) p(pass)
  WHERE words > 0 AND target > 0
    AND ((pass * source_size + upto)::DOUBLE / target <= 2 OR (pass * source_size + upto)::DOUBLE / target - words / target < 1)
), placed AS (
  SELECT *, sum(words) OVER (ORDER BY finish, encode(source) NULLS LAST, h, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS position FROM served
), chosen AS (
  SELECT doc_id, source, size, count(*) AS passes FROM placed WHERE position <= (SELECT sum(source_size) FROM totals) GROUP BY doc_id, source, size
)
SELECT s.doc_id, s.size, q.source_size::BIGINT AS source_size, q.target, (s.size * coalesce(c.passes, 0))::BIGINT AS taken, s.source
FROM sizes s
JOIN queued q ON q.doc_id IS NOT DISTINCT FROM s.doc_id AND q.source IS NOT DISTINCT FROM s.source AND q.size = s.size
LEFT JOIN chosen c ON c.doc_id IS NOT DISTINCT FROM s.doc_id AND c.source IS NOT DISTINCT FROM s.source AND c.size = s.size
"""
