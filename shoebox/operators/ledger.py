"""Ledger and cache statements: keyed upsert, delete, conditional updates, expiry; settings.

Each takes a table's rows and returns its rows afterwards; ``sources.tables`` writes them as
a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import media as M


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """K2, K5: insert or replace by ``key``; ``rows`` has each key once."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_by(base: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """K3, K6, K7: without the rows whose ``column`` is listed."""
    return base.join(keys.select(column).distinct(), column, "left_anti")


def clear(base: DataFrame) -> DataFrame:
    """K4."""
    return base.limit(0)


def saved_bytes(status: Column, original: Column, compressed: Column) -> Column:
    """Nothing for skipped rows; may be negative."""
    return F.when(status == "SKIPPED", F.lit(0).cast("long")).otherwise(original - compressed)


def restorable(status: Column, backup: Column) -> Column:
    """The deadline doesn't matter."""
    return (status == "DONE") & backup.isNotNull()


def restorable_counts(ledger: DataFrame, now_ms: int) -> DataFrame:
    """One row; the recycle bin's count leaves out what is past its deadline."""
    can = restorable(F.col("status"), F.col("backup_rel_path"))
    return ledger.agg(F.count_if(can).alias("settings_count"), F.count_if(can & (F.col("restore_deadline_ms") > now_ms)).alias("recycle_count"))


def exclusion_counts(albums: DataFrame, settings: DataFrame) -> DataFrame:
    """One row: hidden names in the settings' text, and all albums (bucket_name)."""
    hidden = settings.select(F.size(F.array_distinct(excluded_set(F.col("excluded_albums")))).alias("hidden"))
    return albums.agg(F.count_distinct("bucket_name").alias("albums")).crossJoin(F.broadcast(hidden.limit(1)))  # one row each


def mark_failed(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """K8."""
    hit = ledger.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    reason = F.when(F.col("__hit"), schemas.WRITE_FAILED).otherwise(F.col("failure_reason"))
    return hit.withColumns({"status": F.when(F.col("__hit"), "FAILED").otherwise(F.col("status")), "failure_reason": reason}).drop("__hit")


def mark_backups_gone(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed rows that have a backup lose it; of these, DONE becomes PURGED. ``touched`` flags them."""
    hit = ledger.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    touched = F.coalesce(F.col("__hit") & F.col("backup_rel_path").isNotNull(), F.lit(False))
    out = hit.withColumn("touched", touched).withColumns(
        {
            "status": F.when(F.col("touched") & (F.col("status") == "DONE"), "PURGED").otherwise(F.col("status")),
            "backup_size": F.when(F.col("touched"), 0).otherwise(F.col("backup_size")),
            "backup_rel_path": F.when(~F.col("touched"), F.col("backup_rel_path")),
        }
    )
    return out.drop("__hit")


def with_backups(ledger: DataFrame) -> DataFrame:
    """P10."""
    return ledger.filter("backup_rel_path IS NOT NULL")


def expired(ledger: DataFrame, now_ms: int) -> DataFrame:
    """Strictly past the deadline."""
    return with_backups(ledger).filter((F.col("status") == "DONE") & (F.col("restore_deadline_ms") < now_ms))


def excluded_set(text: Column) -> Column:
    """Lines of the settings' text that aren't blank."""
    return F.filter(F.split(text, "\n"), lambda x: ~M.is_blank(x))


def set_album_shown(text: Column, name: Column, shown: Column) -> Column:
    """The text with an album added or removed; lines are sorted."""
    have = excluded_set(text)
    new = F.when(shown, F.array_remove(have, name)).otherwise(F.array_union(have, F.array(name)))
    return F.array_join(F.array_sort(F.array_distinct(new)), "\n")


def insert_if_missing(settings: DataFrame, row: DataFrame) -> DataFrame:
    """An existing row stays as it is."""
    return settings.unionByName(row.join(settings.select("id"), "id", "left_anti"))


def update_settings(settings: DataFrame, **values) -> DataFrame:
    """Only the named columns change."""
    return settings.withColumns({k: F.lit(v).cast(settings.schema[k].dataType) for k, v in values.items()})


def skip_id(volume: Column, media_id: Column, path: Column) -> Column:
    """name-based UUID (version 3) of a skipped item."""
    h = F.md5(F.concat_ws(":", F.lit("skip"), volume, media_id.cast("string"), path).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
