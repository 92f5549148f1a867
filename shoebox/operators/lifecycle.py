"""Batches, purges, reconciliation and recovery, decided from tables instead of a device.

What a codec or a file system would answer arrives as input relations: ``attempts``
(item_key, seq, outcome, saved, reason) and ``files`` (path, length, sha).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import ledger as L


def started(attempts: DataFrame, stop_on: Column) -> DataFrame:
    """Attempts up to and with the first that stops the batch."""
    stop = attempts.filter(stop_on).agg(F.min("seq").alias("stop"))  # one row
    return attempts.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col("seq") <= F.col("stop"))).drop("stop")


def batch_counters(attempts: DataFrame) -> DataFrame:
    """A10: one row; after a failure no further item is started."""
    ran = started(attempts, F.col("outcome") == "FAILED")
    return ran.agg(
        F.count_if(F.col("outcome") == "DONE").alias("done"),
        F.count_if(F.col("outcome") == "SKIPPED").alias("skipped"),
        F.count_if(F.col("outcome") == "FAILED").alias("failed"),
        F.count("*").alias("finished"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "DONE", F.col("saved"))), F.lit(0)).alias("saved"),
    )


def first_reasons(attempts: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` distinct reasons, as they arrived, with their rank."""
    seen = attempts.filter("reason IS NOT NULL").groupBy("reason").agg(F.min("seq").alias("seq"))
    top = seen.orderBy("seq").limit(n).agg(F.array_sort(F.collect_list(F.struct("seq", "reason"))).alias("r"))  # at most n rows
    return top.select(F.posexplode("r").alias("p", "x")).select((F.col("p") + 1).alias("rank"), F.col("x.reason").alias("reason"))


def restore_counters(attempts: DataFrame) -> DataFrame:
    """Stops at the first attempt that didn't succeed."""
    ran = started(attempts, F.col("outcome") != "RESTORED")
    return ran.agg(
        F.count_if(F.col("outcome") == "RESTORED").alias("done"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "RESTORED", F.greatest("saved", F.lit(0)))), F.lit(0)).alias("added"),
        F.count_if(F.col("outcome") == "FAILED").alias("failed"),
        F.count_if(F.col("outcome") == "DATES_PENDING").alias("dates_pending"),
    )


def purge_decisions(records: DataFrame, journal: DataFrame, files: DataFrame, confirmed: bool = False) -> DataFrame:
    """(id, decision, freed) with decision IGNORED, PROTECTED, FAILED or FREED.

    ``files`` holds the media's and the backups' files; a backup file that is gone frees 0 bytes.
    """
    guarded = journal.select(F.explode(F.array_compact(F.array("backup", "safety"))).alias("backup_rel_path")).distinct().withColumn("guarded", F.lit(True))
    original = F.col("status").isin("RESTORED", "FAILED")
    path = F.when(original, F.when(F.col("original_path").rlike(r"^\s*$"), F.col("data_path")).otherwise(F.col("original_path"))).otherwise(F.col("data_path"))
    media = files.select(F.col("path").alias("media_path"), F.col("length").alias("media_length"), F.col("sha").alias("media_sha"))
    backups = files.select(F.col("path").alias("backup_rel_path"), F.col("length").alias("backup_length"))
    rows = records.withColumn("media_path", path).join(guarded, "backup_rel_path", "left").join(media, "media_path", "left").join(backups, "backup_rel_path", "left")
    expected = F.when(original, F.col("original_size")).otherwise(F.col("compressed_size"))
    wrong = F.col("media_length").isNull() | (F.col("media_length") <= 0) | (F.col("media_length") != expected)
    wrong = wrong | (original & (F.col("media_sha") != F.col("original_sha256")))
    trusted = F.lit(confirmed) & F.col("status").isin("DONE", "PURGED")
    decision = F.when(F.col("backup_rel_path").isNull(), "IGNORED").when(F.col("guarded"), "PROTECTED").when(~trusted & wrong, "PROTECTED").otherwise("FREED")
    freed = F.when(F.col("decision") == "FREED", F.coalesce("backup_length", F.lit(0))).otherwise(0)
    return rows.withColumn("decision", decision).select("id", "decision", freed.cast("long").alias("freed"))


def purge_result(decisions: DataFrame) -> DataFrame:
    """A12."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(F.coalesce(F.sum("freed"), F.lit(0)).alias("freed"), of("FAILED").alias("failed"), of("PROTECTED").alias("protected"))


def purge_candidates(ledger: DataFrame, named: DataFrame) -> DataFrame:
    """Rows a user may purge; ``named`` (path) are the journal's paths."""
    rows = ledger.filter(F.col("backup_rel_path").isNotNull() & F.col("status").isin("DONE", "PURGED"))
    rows = rows.join(named.select(F.col("path").alias("data_path")), "data_path", "left_anti")
    return rows.join(named.select(F.col("path").alias("original_path")), "original_path", "left_anti")


def reconcile(records: DataFrame, named: DataFrame, files: DataFrame, live: DataFrame) -> DataFrame:
    """(id, outcome) of rows whose file is the original again: FAILED, or REMOVED where the dates agree too.

    ``live`` (data_path, date_added_sec, date_modified_sec, date_taken_ms, mtime_sec, id) are the catalog's rows.
    """
    blank = lambda c: F.coalesce(F.col(c).rlike(r"^\s*$"), F.lit(True))
    fit = F.col("status").isin("DONE", "FAILED") & F.col("backup_rel_path").isNotNull() & (F.col("original_size") != F.col("compressed_size")) & ~blank("original_sha256")
    rows = records.filter(fit & (blank("original_path") | (F.col("original_path") == F.col("data_path"))))
    rows = rows.join(named.select(F.col("path").alias("data_path")), "data_path", "left_anti")
    own = files.select(F.col("path").alias("data_path"), F.col("length"), F.col("sha"))
    rows = rows.join(own, "data_path").filter((F.col("length") == F.col("original_size")) & (F.col("sha") == F.col("original_sha256")))
    at = live.select("data_path", F.col("id").alias("live_id"), "date_added_sec", "date_modified_sec", "date_taken_ms", "mtime_sec")
    rows = rows.join(at, "data_path", "left")
    dates = (F.col("mtime_sec") == F.col("original_date_modified_sec")) & (F.col("live_id") == F.col("media_store_id"))
    dates = dates & (F.col("date_added_sec") == F.col("original_date_added_sec")) & (F.col("date_modified_sec") == F.col("original_date_modified_sec"))
    taken = F.col("date_taken_ms").isNull() | (F.col("date_taken_ms") <= 0) | (F.col("date_taken_ms") == F.col("original_date_taken_ms"))
    return rows.select("id", F.when(F.coalesce(dates & taken, F.lit(False)), "REMOVED").otherwise("FAILED").alias("outcome"))


def date_differences(expected: Column, found: Column) -> Column:
    """Labels of the dates that differ, in fixed order; null equals null."""
    label = lambda c: F.when(~expected[c].eqNullSafe(found[c]), F.lit(c.upper()))
    return F.array_compact(F.array(label("taken"), label("added"), label("modified")))


def can_keep_added(reason: Column) -> Column:
    """The reason names the date added first, and no other date."""
    return F.coalesce(reason.startswith("ADDED") & ~F.contains(reason, F.lit("TAKEN")) & ~F.contains(reason, F.lit("MODIFIED")), F.lit(False))


def row_usable(trashed: Column, pending: Column, owner: Column, me: str) -> Column:
    """Not trashed, and not pending unless it is ours; unknown states (-1) aren't usable."""
    return (trashed == 0) & ((pending == 0) | ((pending == 1) & F.coalesce(owner == me, F.lit(False))))


def recovery_outcome(digest_ok: Column, differences: Column, accept_added: Column) -> Column:
    """FAILED on another digest; RECOVERED on equal dates, or if only the date added differs and that
    is accepted; else DATES_PENDING."""
    only_added = (F.size(differences) == 1) & (F.try_element_at(differences, F.lit(1)) == "ADDED")
    return F.when(~digest_ok, "FAILED").when((F.size(differences) == 0) | (accept_added & only_added), "RECOVERED").otherwise("DATES_PENDING")


def publish(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a batch leaves in the ledger. ``attempts`` carries whole ledger rows for DONE and SKIPPED."""
    rows = attempts.filter(F.col("outcome").isin("DONE", "SKIPPED")).select(*ledger.columns)
    return ledger.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def restored(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """Restored rows leave the ledger."""
    return ledger.join(attempts.filter("outcome = 'RESTORED'").select("id"), "id", "left_anti")


def ledger_rows(attempts: DataFrame, media: DataFrame, now_ms: int, tier: str = "BALANCED") -> DataFrame:
    """Ledger rows of attempts (key, outcome, new_size, sha, ledger_id, codec) that ended DONE or SKIPPED.

    A skipped item keeps its size, has no backup, and an id made from what identifies it.
    """
    rows = attempts.filter(F.col("outcome").isin("DONE", "SKIPPED")).join(media, "key")
    skipped = F.col("outcome") == "SKIPPED"
    none = F.lit(None).cast("string")
    backup = F.concat_ws("/", F.col("ledger_id"), F.col("display_name"))
    return rows.select(
        F.when(skipped, L.skip_id(F.col("volume_name"), F.col("id"), F.col("data_path"))).otherwise(F.col("ledger_id")).alias("id"),
        F.col("id").alias("media_store_id"),
        "data_path",
        F.col("data_path").alias("original_path"),
        "volume_name",
        "bucket_name",
        "display_name",
        F.col("kind").alias("media_kind"),
        "mime_type",
        F.col("format").alias("container_format"),
        "video_codec",
        F.col("size").alias("original_size"),
        F.when(skipped, F.col("size")).otherwise(F.col("new_size")).alias("compressed_size"),
        F.when(skipped, "").otherwise(F.col("sha")).alias("original_sha256"),
        F.col("date_taken_ms").alias("original_date_taken_ms"),
        F.col("date_added_sec").alias("original_date_added_sec"),
        F.col("date_modified_sec").alias("original_date_modified_sec"),
        F.lit(tier).alias("quality_tier"),
        F.when(~skipped, F.col("codec")).alias("codec_used"),
        F.lit(now_ms).cast("long").alias("compressed_at_ms"),
        F.when(skipped, F.lit(0)).otherwise(F.lit(now_ms + schemas.RETENTION_MS)).cast("long").alias("restore_deadline_ms"),
        F.when(skipped, none).otherwise(backup).alias("backup_rel_path"),
        F.when(skipped, F.lit(0)).otherwise(F.col("size")).cast("long").alias("backup_size"),
        F.col("outcome").alias("status"),
        none.alias("failure_reason"),
    )
