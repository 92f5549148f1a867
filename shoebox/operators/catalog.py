"""Catalog: normalise and classify raw rows, fingerprint, diff against a snapshot, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import media as M

DEFAULT_ALBUM = "UNNAMED"


def visible(raw: DataFrame) -> DataFrame:
    """Neither trashed nor without a path."""
    kept = F.col("is_trashed").isNull() | ~F.col("is_trashed")  # in a form that the scan can take over
    return raw.filter(kept & F.col("data_path").isNotNull() & ~M.is_blank(F.col("data_path")))


def newest_first(df: DataFrame) -> DataFrame:
    """O1; ties by id are ours."""
    return df.orderBy(F.desc("date_added_sec"), "id")


def scan(raw: DataFrame, is_video: bool, ids: DataFrame | None = None) -> DataFrame:
    """One collection, all of it or the rows of ``ids`` (id)."""
    rows = visible(raw).filter(F.col("is_video") == is_video)
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def fingerprints(raw: DataFrame) -> DataFrame:
    """S3: key and what tells a changed row; no other column is read."""
    return visible(raw).select(media_key().alias("key"), "data_path", "date_added_sec", "date_modified_sec")


def media_key():
    return F.concat(F.when(F.col("is_video"), "video:").otherwise("image:"), F.col("id").cast("string"))


def count_of(raw: DataFrame, is_video: bool) -> DataFrame:
    """S4."""
    return raw.filter(F.col("is_video") == is_video).agg(F.count("*").alias("n"))


def to_media(raw: DataFrame, can_preserve_hdr: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Raw catalog rows with their probe columns -> media rows.

    ``files`` (data_path, length), where given, overrides the catalog's size (P4).
    """
    rows = visible(raw)
    if files is not None:
        rows = rows.join(files.select("data_path", "length"), "data_path", "left").withColumn("size", F.coalesce("length", "size"))
    parts = F.split("data_path", "/")
    name = F.coalesce("display_name", F.element_at(parts, -1))
    mime = F.coalesce("mime_type", F.when(F.col("is_video"), "video/*").otherwise("image/*"))
    parent = F.try_element_at(parts, F.lit(-2))
    bucket = F.when(~M.is_blank(F.col("bucket_name")), F.col("bucket_name")).when(~M.is_blank(parent), parent).otherwise(DEFAULT_ALBUM)
    rows = rows.withColumns({"display_name": name, "mime_type": mime, "volume_name": F.coalesce("volume_name", F.lit("external_primary")), "bucket_name": bucket})
    fmt = F.when(F.col("is_video"), M.video_format(F.col("mime_type"), F.col("display_name"))).otherwise(M.image_format(F.col("mime_type"), F.col("display_name")))
    rows = rows.withColumn("format", fmt)
    image = F.coalesce(F.when(F.col("format") == "PNG", F.col("png_reason")), M.image_reason(F.col("format")))
    video = M.video_reason(F.col("format"), F.col("video_codec"), F.col("transfer"), F.col("ten_bit"), can_preserve_hdr)
    side = lambda c: F.when(F.col("is_video") & (F.col(c) <= 0), F.col(f"probe_{c}")).otherwise(F.col(c))
    return rows.select(
        media_key().alias("key"),
        "id",
        "is_video",
        F.concat(F.lit("content://media/external/"), F.when(F.col("is_video"), "video").otherwise("images"), F.lit("/media/"), F.col("id").cast("string")).alias("uri"),
        "data_path",
        "volume_name",
        "bucket_name",
        "display_name",
        "mime_type",
        "size",
        F.when(F.col("date_taken_ms") > 0, F.col("date_taken_ms")).otherwise(F.col("date_added_sec") * 1000).alias("date_taken_ms"),
        "date_added_sec",
        "date_modified_sec",
        side("width").alias("width"),
        side("height").alias("height"),
        M.kind_of(F.col("is_video"), F.col("has_motion"), F.col("format")).alias("kind"),
        "format",
        F.when(F.col("is_video"), video).otherwise(image).alias("skip_reason"),
        F.when(F.col("is_video"), F.col("video_codec")).alias("video_codec"),
        "xmp_compress_id",
    )


def from_cache(cache: DataFrame) -> DataFrame:
    """Cached rows, unknown names of kind and format replaced."""
    return cache.withColumns({"kind": M.parse_kind(F.col("kind")), "format": M.parse_format(F.col("format"))})


def needs_full_scan(last_scan_sec, cached_version, version: int = schemas.CACHE_LOGIC_VERSION):
    """P12, of numbers or columns: never scanned, or scanned by another logic, newer ones included."""
    return (last_scan_sec <= 0) | (cached_version != version)


def diff(cached: DataFrame, live: DataFrame) -> DataFrame:
    """(key, change) of the keys that are new, changed or removed. Size is no part of the fingerprint."""
    stamp = lambda: F.struct("data_path", "date_added_sec", "date_modified_sec")
    a = cached.select("key", stamp().alias("old"))
    b = live.select("key", stamp().alias("new"))
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "key", "full_outer").select("key", change.alias("change")).filter("change IS NOT NULL")


def merge(cached: DataFrame, removed: DataFrame, reprobed: DataFrame) -> DataFrame:
    """Cached rows that were neither removed nor probed again, and those probed again. A row
    whose key changed but that the probe didn't return stays as cached."""
    keep = cached.join(removed.select("key"), "key", "left_anti").join(reprobed.select("key"), "key", "left_anti")
    return keep.unionByName(reprobed)


def incremental_scan(cached: DataFrame, raw: DataFrame, can_preserve_hdr: bool = False) -> DataFrame:
    """Only keys that differ are classified again."""
    changes = diff(cached, fingerprints(raw))
    again = raw.withColumn("key", media_key()).join(changes.filter("change <> 'removed'").select("key"), "key", "left_semi").drop("key")
    return merge(cached, changes.filter("change = 'removed'"), to_media(again, can_preserve_hdr))


def full_scan(raw: DataFrame, can_preserve_hdr: bool = False) -> DataFrame:
    """S6."""
    return to_media(raw, can_preserve_hdr)


def exactly_one(rows: DataFrame, what: str) -> DataFrame:
    """The single row of ``rows``; none or several are an error when the result is used."""
    n = rows.limit(2).agg(F.count("*").alias("n"), F.first(F.struct(*rows.columns)).alias("row"))
    checked = n.withColumn("ok", F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.col("n").cast("string"), F.lit(" rows or more"))).cast("boolean")))
    return checked.filter("ok").select("row.*")


def at_most_one(rows: DataFrame, what: str) -> DataFrame:
    """No row or one; several are an error."""
    n = rows.limit(2).agg(F.count("*").alias("n"), F.first(F.struct(*rows.columns)).alias("row"))
    checked = n.withColumn("ok", F.when(F.col("n") <= 1, F.col("n") == 1).otherwise(F.raise_error(F.lit(f"{what}: several rows")).cast("boolean")))
    return checked.filter("ok").select("row.*")
