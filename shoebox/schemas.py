"""Explicit schemas, value domains, reason codes, and additive migrations.

Schemas are never inferred. A stored table carries its version; reading an older one
adds the columns of each later step with that step's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEDIA = """key string, id bigint, is_video boolean, uri string, data_path string, volume_name string, bucket_name string,
display_name string, mime_type string, size bigint, date_taken_ms bigint, date_added_sec bigint, date_modified_sec bigint,
width int, height int, kind string, format string, skip_reason string, video_codec string, xmp_compress_id string"""
LEDGER = """id string, media_store_id bigint, data_path string, original_path string, volume_name string, bucket_name string,
display_name string, media_kind string, mime_type string, container_format string, video_codec string, original_size bigint,
compressed_size bigint, original_sha256 string, original_date_taken_ms bigint, original_date_added_sec bigint,
original_date_modified_sec bigint, quality_tier string, codec_used string, compressed_at_ms bigint, restore_deadline_ms bigint,
backup_rel_path string, backup_size bigint, status string, failure_reason string"""
SETTINGS = """id int, photo_tier string, compress_png boolean, fast_compress boolean, live_tier string, live_video_tier string,
video_tier string, excluded_albums string, last_scan_sec bigint, cache_logic_version int"""
#: Keys of the JSON documents as they are written.
JOURNAL_JSON = """id string, path string, backup string, sha256 string, mtime string, uri string, taken bigint, added bigint,
modified bigint, safety string, ledgerId string, takenNull boolean, convertedPath string, sourceInode bigint, dateRestorePendingReason string"""

# Domains.
KINDS = ("PHOTO", "LIVE_PHOTO", "VIDEO")
TIERS = ("HIGH", "BALANCED", "COMPACT")
FORMATS = ("JPEG", "HEIC", "PNG", "WEBP", "BMP", "GIF", "AVIF", "DNG", "MP4", "MOV", "MKV", "WEBM", "THREE_GP", "TS", "UNKNOWN")
ACTIVE_STATUSES = ("DONE", "PURGED", "SKIPPED")
RECYCLE_STATUSES = ("DONE", "PURGED")

# Reason codes; one for each branch that refuses an item.
PNG_DISABLED = "PNG_DISABLED"
RECOVERY_PENDING = "RECOVERY_PENDING"
DATES_PENDING = "DATES_PENDING"
WRITE_FAILED = "WRITE_ROLLED_BACK"

CACHE_LOGIC_VERSION = 4
RETENTION_MS = 30 * 86_400_000

#: A fresh install's settings.
FRESH_SETTINGS = {
    "id": 1,
    "photo_tier": "BALANCED",
    "compress_png": True,
    "fast_compress": True,
    "live_tier": "BALANCED",
    "live_video_tier": "BALANCED",
    "video_tier": "BALANCED",
    "excluded_albums": "",
    "last_scan_sec": 0,
    "cache_logic_version": 0,
}

#: What each step adds, with the default for rows that existed before; it may differ from a fresh install's.
MIGRATIONS = {
    "ledger": {2: [("original_path", "string", "")]},
    "settings": {
        2: [("excluded_albums", "string", "")],
        3: [("last_scan_sec", "bigint", 0)],
        4: [("live_video_tier", "string", "BALANCED")],
        5: [("cache_logic_version", "int", 0)],
        6: [("compress_png", "boolean", False)],
        7: [("fast_compress", "boolean", False)],
    },
}
VERSION = 7


def migrate(df: DataFrame, table: str, version: int) -> DataFrame:
    """``df``, stored at ``version``, with the columns of all later steps."""
    for step in sorted(s for s in MIGRATIONS.get(table, {}) if s > version):
        for name, kind, default in MIGRATIONS[table][step]:
            if name not in df.columns:
                df = df.withColumn(name, F.lit(default).cast(kind))
    return df
