"""Queries by operator, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..functions import media as M
from ..operators import catalog, ledger, lifecycle, selection, views
from ..sources import files
from ..sources.driver import NOW_MS, Driver
from .oracle import sql

QUERIES: dict[str, Callable[[Driver], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def add(f: Callable[[Driver], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return f

    return add


MEDIA_COLUMNS = "key, id, is_video, uri, data_path, volume_name, bucket_name, display_name, mime_type, size, date_taken_ms, date_added_sec, date_modified_sec, width, height, kind, format, skip_reason, video_codec, xmp_compress_id"
_MEDIA_LIST = MEDIA_COLUMNS.split(", ")
_VISIBLE = "FROM raw WHERE NOT is_trashed AND trim(data_path) <> ''"


# Scans and sources.
query("s1_image_scan", f"SELECT id, data_path, display_name, size, date_added_sec {_VISIBLE} AND NOT is_video")(
    lambda d: catalog.newest_first(catalog.scan(d.raw(), False)).select("id", "data_path", "display_name", "size", "date_added_sec")
)
query("s2_video_scan", f"SELECT id, data_path, width, height, video_codec {_VISIBLE} AND is_video")(lambda d: catalog.scan(d.raw(), True).select("id", "data_path", "width", "height", "video_codec"))
query("s3_fingerprints", f"SELECT CASE WHEN is_video THEN 'video:' ELSE 'image:' END || id AS key, data_path, date_added_sec, date_modified_sec {_VISIBLE}")(lambda d: catalog.fingerprints(d.raw()))
query("s4_count", "SELECT count(*) AS n FROM raw WHERE NOT is_video")(lambda d: catalog.count_of(d.raw(), False))
query("s5_id_scan", f"SELECT id, data_path {_VISIBLE} AND NOT is_video AND id IN (SELECT s_suppkey * 37 FROM supplier)")(
    lambda d: catalog.scan(d.raw(), False, d.table("supplier").select((F.col("s_suppkey") * 37).alias("id"))).select("id", "data_path")
)
query("s6_full_scan", f"SELECT {MEDIA_COLUMNS} FROM media")(lambda d: catalog.full_scan(d.raw()))
query(
    "s7_incremental_scan",
    f"SELECT {MEDIA_COLUMNS} FROM cache c WHERE EXISTS (SELECT 1 FROM media m WHERE m.key = c.key AND m.data_path = c.data_path AND m.date_added_sec = c.date_added_sec AND m.date_modified_sec = c.date_modified_sec)"
    f" UNION ALL SELECT {MEDIA_COLUMNS} FROM media m WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE m.key = c.key AND m.data_path = c.data_path AND m.date_added_sec = c.date_added_sec AND m.date_modified_sec = c.date_modified_sec)",
)(lambda d: catalog.incremental_scan(d.cache(), d.raw()))
query("s8_cache_read", f"SELECT {MEDIA_COLUMNS} FROM cache")(lambda d: catalog.from_cache(d.cache()))
query("p1_visible", f"SELECT id {_VISIBLE}")(lambda d: catalog.visible(d.raw()).select("id"))
query("p2_p3_fallbacks", "SELECT id, display_name, mime_type, volume_name, bucket_name FROM media")(lambda d: d.media().select("id", "display_name", "mime_type", "volume_name", "bucket_name"))
query("p4_size_override", "SELECT m.id, coalesce(f.length, m.size) AS size FROM media m LEFT JOIN files f ON f.path = m.data_path")(
    lambda d: catalog.to_media(d.raw(), files=d.files().select(F.col("path").alias("data_path"), "length")).select("id", "size")
)
query("p5_p6_date_and_size", "SELECT id, date_taken_ms, width, height FROM media")(lambda d: d.media().select("id", "date_taken_ms", "width", "height"))

# Classification.
query("f1_extension", "SELECT id, CASE WHEN contains(display_name, '.') THEN lower(split_part(display_name, '.', -1)) ELSE '' END AS ext FROM raw")(lambda d: d.raw().select("id", M.extension_of(F.col("display_name")).alias("ext")))
query("f2_f3_format", "SELECT id, format FROM media")(lambda d: d.media().select("id", "format"))
query("f4_f5_f6_support", "SELECT coalesce(skip_reason, 'SUPPORTED') AS reason, count(*) AS n FROM media GROUP BY 1")(
    lambda d: d.media().groupBy(F.coalesce("skip_reason", F.lit("SUPPORTED")).alias("reason")).agg(F.count("*").alias("n"))
)
query("f5_capable_device", "SELECT id, CASE WHEN format <> 'MP4' THEN 'CONTAINER_' || format WHEN video_codec IS NULL THEN 'NO_VIDEO_TRACK' END AS skip_reason FROM media WHERE is_video")(
    lambda d: catalog.to_media(d.raw(), can_preserve_hdr=True).filter("is_video").select("id", "skip_reason")
)
query("f7_kind", "SELECT kind, count(*) AS n FROM media GROUP BY kind")(lambda d: d.media().groupBy("kind").agg(F.count("*").alias("n")))
_HDR = "CASE WHEN transfer IN (6, 16) THEN 'PQ' WHEN transfer IN (7, 18) THEN 'HLG' WHEN ten_bit THEN 'OTHER' ELSE 'NONE' END"
query("f8_hdr", f"SELECT id, {_HDR} AS hdr_kind, ten_bit OR {_HDR} <> 'NONE' AS hdr, id % 3 = 2 OR id % 5 = 2 AS main10 FROM raw")(
    lambda d: d.raw().select(
        "id",
        M.hdr_kind(F.col("transfer"), F.col("ten_bit")).alias("hdr_kind"),
        M.is_hdr(F.col("transfer"), F.col("ten_bit")).alias("hdr"),
        M.is_main10(F.when(F.col("id") % 3 == 2, 4096).otherwise(1), F.when(F.col("id") % 5 == 2, 10).otherwise(8)).alias("main10"),
    )
)
query("f9_ten_bit_flag", "SELECT id, transfer IN (6, 7, 16, 18) OR id % 9 = 1 OR (coalesce(video_codec = 'video/hevc', false) AND id % 3 = 2) OR id % 11 = 2 AS flag FROM raw")(
    lambda d: d.raw().select(
        "id", M.ten_bit_flag(F.col("transfer"), F.when(F.col("id") % 9 == 1, 6).otherwise(1), F.col("video_codec"), F.when(F.col("id") % 3 == 2, 2).otherwise(1), F.when(F.col("id") % 11 == 2, 10).otherwise(8)).alias("flag")
    )
)


@query(
    "f11_compare_hdr",
    """, s AS (SELECT id, transfer AS st, ten_bit AS sb, CASE WHEN id % 3 = 0 THEN transfer WHEN id % 3 = 1 THEN 7 ELSE 1 END AS ot, id % 8 = 0 AS ob, id % 2 = 0 AS sm, id % 4 = 0 AS om, id % 5 = 0 AS s2020, id % 10 = 0 AS o2020 FROM raw),
    k AS (SELECT *, CASE WHEN st IN (6, 16) THEN 'PQ' WHEN st IN (7, 18) THEN 'HLG' WHEN sb THEN 'OTHER' ELSE 'NONE' END AS sk, CASE WHEN ot IN (6, 16) THEN 'PQ' WHEN ot IN (7, 18) THEN 'HLG' WHEN ob THEN 'OTHER' ELSE 'NONE' END AS ok FROM s),
    i AS (SELECT *, CASE WHEN sk = 'NONE' THEN 0 ELSE (sk <> ok)::INT + (sm AND NOT om)::INT + (s2020 AND NOT o2020)::INT END AS issues FROM k)
    SELECT id, CASE WHEN sk = 'NONE' THEN 'PRESERVED' WHEN ok = 'NONE' THEN 'LOST' WHEN issues = 0 THEN 'PRESERVED' ELSE 'DEGRADED' END AS fidelity, issues FROM i""",
)
def _(d: Driver) -> DataFrame:
    i = F.col("id")
    side = lambda t, b, m, std: F.struct(t.alias("transfer"), b.alias("ten_bit"), F.when(m, 2).otherwise(1).alias("profile"), F.lit(8).alias("depth"), F.when(std, 6).otherwise(1).alias("standard"))
    out = F.when(i % 3 == 0, F.col("transfer")).when(i % 3 == 1, 7).otherwise(1)
    rows = d.raw().select("id", side(F.col("transfer"), F.col("ten_bit"), i % 2 == 0, i % 5 == 0).alias("s"), side(out, i % 8 == 0, i % 4 == 0, i % 10 == 0).alias("o"))
    fidelity, issues = M.compare_hdr(F.col("s"), F.col("o"))
    return rows.select("id", fidelity.alias("fidelity"), F.size(issues).alias("issues"))


query("f12_codec_label", "SELECT id, CASE video_codec WHEN 'video/avc' THEN 'H.264' WHEN 'video/hevc' THEN 'HEVC' ELSE coalesce(video_codec, 'UNKNOWN') END AS label FROM raw")(lambda d: d.raw().select("id", M.codec_label(F.col("video_codec")).alias("label")))
query("p29_enum_defaults", "SELECT id, CASE WHEN quality_tier IN ('HIGH', 'BALANCED', 'COMPACT') THEN quality_tier ELSE 'BALANCED' END AS tier, CASE WHEN media_kind = 'BOGUS' THEN 'PHOTO' ELSE media_kind END AS kind FROM ledger")(
    lambda d: d.ledger().select("id", M.parse_tier(F.col("quality_tier")).alias("tier"), M.parse_kind(F.col("media_kind")).alias("kind"))
)

# Diff, merge and statements on tables.
_SAME = "c.data_path = m.data_path AND c.date_added_sec = m.date_added_sec AND c.date_modified_sec = m.date_modified_sec"
query("j1_diff", f"SELECT coalesce(c.key, m.key) AS key, CASE WHEN m.key IS NULL THEN 'removed' WHEN c.key IS NULL THEN 'new' ELSE 'changed' END AS change FROM cache c FULL JOIN media m ON c.key = m.key WHERE m.key IS NULL OR c.key IS NULL OR NOT ({_SAME})")(
    lambda d: catalog.diff(d.cache(), catalog.fingerprints(d.raw()))
)
query("j2_merge_unreturned", f"SELECT {MEDIA_COLUMNS} FROM media WHERE id % 5 = 0 UNION ALL SELECT {MEDIA_COLUMNS} FROM cache WHERE id % 5 <> 0 AND key IN (SELECT key FROM media)")(
    lambda d: catalog.merge(d.cache(), catalog.diff(d.cache(), catalog.fingerprints(d.raw())).filter("change = 'removed'"), d.media().filter("id % 5 = 0"))
)
query("k2_upsert", f"SELECT {MEDIA_COLUMNS} FROM media WHERE id % 4 = 0 UNION ALL SELECT {MEDIA_COLUMNS} FROM cache WHERE key NOT IN (SELECT key FROM media WHERE id % 4 = 0)")(lambda d: ledger.upsert(d.cache(), d.media().filter("id % 4 = 0"), "key"))
query("k3_delete_by_key", "SELECT key FROM cache WHERE key NOT IN (SELECT key FROM media WHERE id % 4 = 0)")(lambda d: ledger.delete_by(d.cache(), d.media().filter("id % 4 = 0"), "key").select("key"))
query("k3_delete_by_path", "SELECT key FROM cache WHERE data_path NOT IN (SELECT data_path FROM media WHERE id % 6 = 0)")(lambda d: ledger.delete_by(d.cache(), d.media().filter("id % 6 = 0"), "data_path").select("key"))
query("k4_clear", "SELECT key FROM cache WHERE false")(lambda d: ledger.clear(d.cache()).select("key"))
query("k6_ledger_delete", "SELECT id FROM ledger WHERE media_store_id % 7 <> 0")(lambda d: ledger.delete_by(d.ledger(), d.ledger().filter("media_store_id % 7 = 0"), "id").select("id"))
query("k8_mark_failed", "SELECT id, CASE WHEN media_store_id % 10 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN media_store_id % 10 = 0 THEN 'WRITE_ROLLED_BACK' END AS failure_reason FROM ledger")(
    lambda d: ledger.mark_failed(d.ledger(), d.ledger().filter("media_store_id % 10 = 0")).select("id", "status", "failure_reason")
)
query(
    "k10_mark_backups_gone",
    "SELECT id, hit AS touched, CASE WHEN hit AND status = 'DONE' THEN 'PURGED' ELSE status END AS status, CASE WHEN NOT hit THEN backup_rel_path END AS backup_rel_path, CASE WHEN hit THEN 0 ELSE backup_size END AS backup_size FROM (SELECT *, media_store_id % 2 = 0 AND backup_rel_path IS NOT NULL AS hit FROM ledger)",
)(lambda d: ledger.mark_backups_gone(d.ledger(), d.ledger().filter("media_store_id % 2 = 0")).select("id", "touched", "status", "backup_rel_path", "backup_size"))
query("k11_settings_missing", "SELECT 1 AS id, false AS compress_png UNION ALL SELECT 2, true")(lambda d: ledger.insert_if_missing(d.settings(compress_png=False), d.settings().union(d.settings(id=2))).select("id", "compress_png"))
query("k12_settings_update", "SELECT 1 AS id, true AS compress_png, 77 AS last_scan_sec, 4 AS cache_logic_version")(
    lambda d: ledger.update_settings(d.settings(), last_scan_sec=77, cache_logic_version=4).select("id", "compress_png", "last_scan_sec", "cache_logic_version")
)
query("k14_exclusions", "SELECT id, CASE WHEN id % 2 = 0 THEN 'album_11\nalbum_3' || CASE WHEN bucket_name IN ('album_11', 'album_3') THEN '' ELSE '' END ELSE 'album_11\nalbum_3\nalbum_7' END AS text FROM media WHERE bucket_name = 'album_7'")(
    lambda d: d.media().filter("bucket_name = 'album_7'").crossJoin(F.broadcast(d.settings().select("excluded_albums"))).select("id", ledger.set_album_shown(F.col("excluded_albums"), F.col("bucket_name"), F.col("id") % 2 == 0).alias("text"))
)
query("p8_p9_ledger_columns", "SELECT id, status = 'DONE' AND backup_rel_path IS NOT NULL AS restorable, CASE WHEN status = 'SKIPPED' THEN 0 ELSE original_size - compressed_size END AS saved FROM ledger")(
    lambda d: d.ledger().select("id", ledger.restorable(F.col("status"), F.col("backup_rel_path")).alias("restorable"), ledger.saved_bytes(F.col("status"), F.col("original_size"), F.col("compressed_size")).alias("saved"))
)
query("p10_with_backups", "SELECT id FROM ledger WHERE backup_rel_path IS NOT NULL")(lambda d: ledger.with_backups(d.ledger()).select("id"))
query("p11_expired", f"SELECT id FROM ledger WHERE status = 'DONE' AND backup_rel_path IS NOT NULL AND restore_deadline_ms < {NOW_MS}")(lambda d: ledger.expired(d.ledger(), NOW_MS).select("id"))
query("f26_skip_id", "SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', position(substr(h, 17, 1) IN '0123456789abcdef'), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS skip_id FROM (SELECT id, md5('skip:' || volume_name || ':' || id || ':' || data_path) AS h FROM media)")(
    lambda d: d.media().select("id", ledger.skip_id(F.col("volume_name"), F.col("id"), F.col("data_path")).alias("skip_id"))
)

# Views.
query("j3_done", "SELECT id, data_path, bucket_name, kind, original_size, compressed_size, saved, restorable, skipped, adopted, quality_tier FROM done")(
    lambda d: d.library().done.select("id", "data_path", "bucket_name", "kind", "original_size", "compressed_size", "saved", "restorable", "skipped", "adopted", "quality_tier")
)
query("j4_j5_active_ledger", "SELECT id, status FROM active")(lambda d: d.library().active.select("id", "status"))
query("j5_recycle_list", "SELECT id FROM ledger WHERE status IN ('DONE', 'PURGED') AND backup_rel_path IS NOT NULL AND data_path NOT IN (SELECT path FROM jpaths) AND original_path NOT IN (SELECT path FROM jpaths)")(lambda d: d.library().backups().select("id"))
query("j6_todo", "SELECT key, bucket_name, size, kind, skip_reason FROM todo")(lambda d: d.library().todo.select("key", "bucket_name", "size", "kind", "skip_reason"))
query("j7_item_entry", "SELECT key, pos FROM hits")(lambda d: d.library().matches.select("key", F.col("entry.pos").alias("pos")))
query("j8_missing", "SELECT 'journal:' || id AS key, CAST(split_part(media_uri, '/', -1) AS BIGINT) AS id, bucket_name, split_part(path, '/', -1) AS display_name, reason AS skip_reason FROM missing")(
    lambda d: d.library().missing.select("key", "id", "bucket_name", "display_name", "skip_reason")
)
query("j9_adopted", "SELECT id, data_path, compressed_size FROM done WHERE adopted")(lambda d: d.library().done.filter("adopted").select("id", "data_path", "compressed_size"))
query("p18_png_setting_off", "SELECT key, CASE WHEN format = 'PNG' AND NOT starts_with(coalesce(skip_reason, ''), 'DATES') AND coalesce(skip_reason, '') <> 'RECOVERY_PENDING' THEN 'PNG_DISABLED' ELSE skip_reason END AS skip_reason FROM todo")(
    lambda d: d.library(compress_png=False).todo.select("key", "skip_reason")
)
_A1 = "SELECT bucket_name, count(*) AS count, sum(size)::BIGINT AS bytes, count(*) FILTER (skip_reason IS NULL) AS compressible_count, coalesce(sum(size) FILTER (skip_reason IS NULL), 0)::BIGINT AS compressible_bytes, count(*) FILTER (skip_reason = 'RECOVERY_PENDING' OR starts_with(skip_reason, 'DATES_PENDING')) AS pending_count FROM todo GROUP BY bucket_name"
query("a1_todo_albums", f"SELECT *, row_number() OVER (ORDER BY count DESC, bucket_name) AS rank FROM ({_A1})")(lambda d: views.ranked(d.library().todo_albums()))
query(
    "a2_done_albums",
    "SELECT bucket_name, count(*) AS count, count(*) FILTER (NOT adopted AND NOT skipped) AS known_before_count, sum(original_size)::BIGINT AS before, sum(compressed_size)::BIGINT AS after, sum(CASE WHEN adopted THEN 0 ELSE greatest(saved, 0) END)::BIGINT AS saved, count(*) FILTER (restorable) AS restorable_count, bool_and(skipped) AS all_skipped FROM done GROUP BY bucket_name",
)(lambda d: d.library().done_albums())
query("a3_album_names", "SELECT bucket_name, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(ord), bucket_name) AS rank FROM media GROUP BY bucket_name")(
    lambda d: views.ranked((lib := d.library()).album_names(), views.first_seen(lib.items))
)
query(
    "a4_totals",
    """, t AS (SELECT count(*) AS todo_count, coalesce(sum(size), 0)::BIGINT AS todo_bytes FROM todo),
    g AS (SELECT count(*) AS done_count, coalesce(sum(original_size) FILTER (NOT adopted), 0)::BIGINT AS before, coalesce(sum(compressed_size) FILTER (NOT adopted), 0)::BIGINT AS after, count(*) FILTER (restorable) AS restorable_count, coalesce(sum(original_size) FILTER (restorable), 0)::BIGINT AS restorable_bytes FROM done)
    SELECT *, greatest(before - after, 0) AS saved, CAST(CAST(CAST(greatest(before - after, 0) AS FLOAT) / CAST(before + todo_bytes AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT) AS FLOAT) AS pct FROM t, g""",
)(lambda d: d.library().totals())
_A5 = "SELECT k.kind, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM (VALUES ('PHOTO'), ('LIVE_PHOTO'), ('VIDEO')) k(kind) LEFT JOIN (SELECT kind, size AS bytes FROM todo UNION ALL SELECT kind, coalesce(item_size, compressed_size) FROM done) b ON b.kind = k.kind GROUP BY 1"
query("a5_kind_bytes", _A5)(lambda d: d.library().kind_bytes())
query("a7_list_headers", f"SELECT count(*) AS albums, sum(count)::BIGINT AS items, sum(bytes)::BIGINT AS bytes, sum(compressible_count)::BIGINT AS compressible FROM ({_A1}) WHERE compressible_count > 0 OR pending_count > 0")(
    lambda d: views.list_headers(d.library().todo_albums())
)
query("a8_kind_shares", f"SELECT kind, bytes, CAST(floor(CAST(CAST(CAST(bytes AS FLOAT) / CAST(sum(bytes) OVER () AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT) AS DOUBLE) + 0.5) AS INT) AS percent FROM ({_A5})")(lambda d: d.library().kind_shares())
query(
    "a9_ratios",
    "SELECT id, CAST(CASE WHEN original_size + compressed_size <= 0 THEN 0.5 ELSE greatest(least(CAST(CAST(original_size AS DOUBLE) / CAST(original_size + compressed_size AS DOUBLE) AS FLOAT), CAST(0.9999 AS FLOAT)), CAST(0.0001 AS FLOAT)) END AS FLOAT) AS l FROM ledger",
)(lambda d: d.ledger().select("id", fmt.comparison_ratios(F.col("original_size").cast("double"), F.col("compressed_size").cast("double"))[0].alias("l")))
query("a13_recycle_size", "SELECT coalesce(sum(length), 0)::BIGINT AS bytes FROM files WHERE starts_with(path, 'b/')")(lambda d: files.total_size(d.files().filter(F.col("path").startswith("b/"))))
query("a14_a15_restorable_counts", f"SELECT count(*) FILTER (status = 'DONE' AND backup_rel_path IS NOT NULL) AS settings_count, count(*) FILTER (status = 'DONE' AND backup_rel_path IS NOT NULL AND restore_deadline_ms > {NOW_MS}) AS recycle_count FROM ledger")(
    lambda d: ledger.restorable_counts(d.ledger(), NOW_MS)
)
query("o3_covers", "SELECT bucket_name, row_number() OVER (PARTITION BY bucket_name ORDER BY is_video, date_added_sec DESC, id) AS rank, id FROM available QUALIFY rank <= 4")(lambda d: d.library().covers())
query("p14_expired_filter", "SELECT id FROM done WHERE NOT restorable AND NOT skipped")(lambda d: selection.done_filter(d.library().done, "expired").select("id"))
query("p13_todo_filters", "SELECT 'skip' AS f, count(*) AS n FROM todo WHERE skip_reason IS NOT NULL UNION ALL SELECT 'photo', count(*) FROM todo WHERE skip_reason IS NULL AND kind = 'PHOTO' UNION ALL SELECT 'live', count(*) FROM todo WHERE skip_reason IS NULL AND kind = 'LIVE_PHOTO' UNION ALL SELECT 'video', count(*) FROM todo WHERE skip_reason IS NULL AND kind = 'VIDEO' UNION ALL SELECT 'all', count(*) FROM todo")(
    lambda d: _filter_counts(d.library().todo)
)
query("p24_todo_badges", "SELECT CASE WHEN starts_with(skip_reason, 'DATES') THEN 'DATES' WHEN skip_reason = 'RECOVERY_PENDING' THEN 'FAILED' WHEN skip_reason IS NOT NULL THEN 'UNSUPPORTED' WHEN kind = 'LIVE_PHOTO' THEN 'LIVE' WHEN kind = 'VIDEO' THEN 'VIDEO' ELSE 'NONE' END AS badge, count(*) AS n FROM todo GROUP BY 1")(
    lambda d: d.library().todo.groupBy(_todo_badge().alias("badge")).agg(F.count("*").alias("n"))
)
_DAYS = f"CAST(trunc((restore_deadline_ms - {NOW_MS}) / 86400000) AS BIGINT)"
query("p25_done_badges", f"SELECT id, CASE WHEN skipped THEN 'SKIPPED' WHEN adopted THEN 'ADOPTED' WHEN status = 'PURGED' OR {_DAYS} < 0 THEN 'EXPIRED' ELSE 'COMPRESSED' END AS badge FROM done")(
    lambda d: d.library().done.select("id", views.done_badge(F.col("skipped"), F.col("adopted"), F.col("status"), fmt.days_left(F.col("restore_deadline_ms"), NOW_MS)).alias("badge"))
)
query("p26_recycle_states", f"SELECT id, CASE WHEN restore_deadline_ms <= {NOW_MS} THEN 'EXPIRED' WHEN status = 'DONE' AND backup_rel_path IS NOT NULL THEN 'AVAILABLE' ELSE 'RESIDUAL' END AS state FROM ledger")(
    lambda d: d.ledger().select("id", views.recycle_state(ledger.restorable(F.col("status"), F.col("backup_rel_path")), F.col("restore_deadline_ms"), NOW_MS).alias("state"))
)
query("p27_detail_states", f"SELECT id, CASE WHEN skipped THEN 'SKIPPED' WHEN adopted THEN 'ADOPTED' WHEN status = 'PURGED' THEN 'PURGED' WHEN NOT restorable THEN 'NOT_RESTORABLE' ELSE 'DAYS_' || {_DAYS} END AS state FROM done")(
    lambda d: d.library().done.select("id", views.detail_state(F.col("skipped"), F.col("adopted"), F.col("status"), F.col("restorable"), fmt.days_left(F.col("restore_deadline_ms"), NOW_MS)).alias("state"))
)
query("f17_days_left", f"SELECT id, {_DAYS} AS days FROM ledger")(lambda d: d.ledger().select("id", fmt.days_left(F.col("restore_deadline_ms"), NOW_MS).alias("days")))
query("f20_f22_estimates", "SELECT id, CAST(floor(size * 0.37::DOUBLE) AS BIGINT) AS saving, CAST(greatest(least(floor(width::DOUBLE * height * 0.09::DOUBLE * greatest(least(id % 90, 60), 24)), 40000000), 300000) AS INT) AS bitrate FROM media")(
    lambda d: d.media().select("id", fmt.estimated_saving(F.col("size")).alias("saving"), fmt.estimate_bitrate(F.col("width"), F.col("height"), F.col("id") % 90).alias("bitrate"))
)
query("f21_quality", "SELECT id, CASE format WHEN 'JPEG' THEN CASE id % 3 WHEN 0 THEN 92 WHEN 1 THEN 85 ELSE 76 END WHEN 'HEIC' THEN CASE id % 3 WHEN 0 THEN 75 WHEN 1 THEN 55 ELSE 35 END END AS quality FROM media")(
    lambda d: d.media().select("id", fmt.quality(F.col("format"), F.when(F.col("id") % 3 == 0, "HIGH").when(F.col("id") % 3 == 1, "BALANCED").otherwise("COMPACT")).alias("quality"))
)
query("f27_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")(lambda d: files.with_digest(d.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))).select("doc_id", "sha"))
query("j12_orphan_backups", "SELECT path FROM files WHERE (starts_with(path, 'b/') OR starts_with(path, 'orphan/')) AND path NOT IN (SELECT backup_rel_path FROM ledger WHERE backup_rel_path IS NOT NULL) AND path NOT IN (SELECT backup FROM journal) AND path NOT IN (SELECT safety FROM journal WHERE safety IS NOT NULL)")(
    lambda d: d.library().orphans(d.files().filter("path LIKE 'b/%' OR path LIKE 'orphan/%'")).select("path")
)

# Selections.
query("a6_todo_selection", "SELECT count(*) AS count, coalesce(sum(size), 0)::BIGINT AS bytes, 0::BIGINT AS after_bytes, count(*) FILTER (kind = 'PHOTO') AS photos, count(*) FILTER (kind = 'LIVE_PHOTO') AS lives, count(*) FILTER (kind = 'VIDEO') AS videos, list_sort(list(DISTINCT bucket_name)) AS albums, coalesce(sum(size), 0)::BIGINT AS saved_bytes FROM todo WHERE skip_reason IS NULL AND bucket_name IN ('album_1', 'album_2', 'album_3')")(
    lambda d: selection.summary(selection.pick_albums(d.library().todo, _names(d, "album_1", "album_2", "album_3"), F.col("skip_reason").isNull()), "size")
)
query("j10_done_selection", "SELECT count(*) AS count, sum(original_size)::BIGINT AS bytes, sum(compressed_size)::BIGINT AS after_bytes, greatest(sum(original_size) - sum(compressed_size), 0)::BIGINT AS saved_bytes FROM done WHERE restorable AND bucket_name IN ('album_1', 'album_5')")(
    lambda d: selection.summary(selection.pick_albums(d.library().done, _names(d, "album_1", "album_5"), F.col("restorable")), "original_size", "compressed_size").select("count", "bytes", "after_bytes", "saved_bytes")
)
query("j11_level2_selection", "SELECT id FROM todo WHERE bucket_name = 'album_2' AND skip_reason IS NULL AND kind = 'PHOTO' AND id IN (SELECT id FROM media WHERE id % 4 = 1)")(
    lambda d: selection.pick_items(selection.todo_filter(d.library().todo, "photo"), "album_2", d.media().filter("id % 4 = 1"), F.col("skip_reason").isNull()).select("id")
)
query("u4_toggle", "SELECT id, CASE WHEN bucket_name IN ('album_1', 'album_2') THEN list_filter(['album_1', 'album_2'], lambda x: x <> bucket_name) ELSE list_sort(list_append(['album_1', 'album_2'], bucket_name)) END AS picked FROM media")(
    lambda d: d.media().select("id", selection.toggle(F.array(F.lit("album_1"), F.lit("album_2")), F.col("bucket_name")).alias("picked"))
)
query("a16_quantifiers", "SELECT bucket_name, bool_and(id % 2 = 0) AS every, bool_or(id % 2 = 0) AS some FROM media GROUP BY 1")(lambda d: selection.quantifiers(d.media(), "bucket_name", F.col("id") % 2 == 0))
query("p28_tiers", "SELECT id, CASE kind WHEN 'VIDEO' THEN 'HIGH' WHEN 'LIVE_PHOTO' THEN 'COMPACT' ELSE 'BALANCED' END AS image_tier, CASE kind WHEN 'VIDEO' THEN 'HIGH' ELSE 'BALANCED' END AS video_tier FROM media")(
    lambda d: d.media().select("id", selection.tier_of(F.col("kind"), F.lit("image"), _TIERS).alias("image_tier"), selection.tier_of(F.col("kind"), F.lit("video"), _TIERS).alias("video_tier"))
)
query("p30_parallelism", "SELECT CASE WHEN bool_or((format = 'PNG' AND (width <= 0 OR height <= 0 OR width::BIGINT * height > 16000000)) OR (format = 'HEIC' AND (width <= 0 OR height <= 0 OR width::BIGINT * height > 20000000))) THEN 1 ELSE 3 END AS parallelism, bucket_name FROM media GROUP BY bucket_name")(
    # An album is a batch.
    lambda d: selection.parallelism(d.media(), True, 3 << 30, 8, by="bucket_name")
)

# Lifecycle.
_STARTED = ", st AS (SELECT * FROM attempts WHERE seq <= coalesce((SELECT min(seq) FROM attempts WHERE outcome = 'FAILED'), 9223372036854775807)) "
query("a10_batch_counters", _STARTED + "SELECT count(*) FILTER (outcome = 'DONE') AS done, count(*) FILTER (outcome = 'SKIPPED') AS skipped, count(*) FILTER (outcome = 'FAILED') AS failed, count(*) AS finished, coalesce(sum(saved) FILTER (outcome = 'DONE'), 0)::BIGINT AS saved FROM st")(
    lambda d: lifecycle.batch_counters(d.attempts())
)
query("o4_first_reasons", "SELECT row_number() OVER (ORDER BY min(seq)) AS rank, reason FROM attempts WHERE reason IS NOT NULL GROUP BY reason ORDER BY rank LIMIT 3")(lambda d: lifecycle.first_reasons(d.attempts()))
query("t8_started", _STARTED + "SELECT id FROM st")(lambda d: lifecycle.started(d.attempts(), F.col("outcome") == "FAILED").select("id"))
_PURGE = """, dec AS (SELECT l.id, CASE WHEN l.backup_rel_path IS NULL THEN 'IGNORED'
    WHEN l.backup_rel_path IN (SELECT backup FROM journal) OR l.backup_rel_path IN (SELECT safety FROM journal WHERE safety IS NOT NULL) THEN 'PROTECTED'
    WHEN {trust} AND (f.length IS NULL OR f.length <= 0 OR f.length <> CASE WHEN o THEN l.original_size ELSE l.compressed_size END OR (o AND f.sha <> l.original_sha256)) THEN 'PROTECTED' ELSE 'FREED' END AS decision, coalesce(b.length, 0) AS len
  FROM (SELECT *, status IN ('RESTORED', 'FAILED') AS o FROM ledger) l LEFT JOIN files f ON f.path = CASE WHEN o AND trim(original_path) <> '' THEN original_path ELSE data_path END LEFT JOIN files b ON b.path = l.backup_rel_path) """
query("t4_purge", _PURGE.format(trust="true") + "SELECT id, decision, CASE WHEN decision = 'FREED' THEN len ELSE 0 END AS freed FROM dec")(lambda d: lifecycle.purge_decisions(d.ledger(), d.journal(), d.files()))
query("a12_purge_result", _PURGE.format(trust="NOT l.status IN ('DONE', 'PURGED')") + "SELECT coalesce(sum(len) FILTER (decision = 'FREED'), 0)::BIGINT AS freed, 0::BIGINT AS failed, count(*) FILTER (decision = 'PROTECTED') AS protected FROM dec")(
    lambda d: lifecycle.purge_result(lifecycle.purge_decisions(d.ledger(), d.journal(), d.files(), confirmed=True))
)
query("j14_purge_candidates", "SELECT id FROM ledger WHERE backup_rel_path IS NOT NULL AND status IN ('DONE', 'PURGED') AND data_path NOT IN (SELECT path FROM jpaths) AND original_path NOT IN (SELECT path FROM jpaths)")(
    lambda d: lifecycle.purge_candidates(d.ledger(), views.journal_paths(d.journal())).select("id")
)
query(
    "t5_reconcile",
    """SELECT l.id, CASE WHEN i.id = l.media_store_id AND i.date_modified_sec + i.id % 2 = l.original_date_modified_sec AND i.date_added_sec = l.original_date_added_sec AND i.date_modified_sec = l.original_date_modified_sec
      AND i.date_taken_ms = l.original_date_taken_ms THEN 'REMOVED' ELSE 'FAILED' END AS outcome
    FROM ledger l JOIN files f ON f.path = l.data_path AND f.length = l.original_size AND f.sha = l.original_sha256 LEFT JOIN bypath i ON i.data_path = l.data_path
    WHERE l.status IN ('DONE', 'FAILED') AND l.backup_rel_path IS NOT NULL AND l.original_size <> l.compressed_size AND trim(l.original_sha256) <> ''
      AND (trim(l.original_path) = '' OR l.original_path = l.data_path) AND l.data_path NOT IN (SELECT path FROM jpaths)""",
)(lambda d: lifecycle.reconcile(d.ledger(), views.journal_paths(d.journal()), d.files(), _live_dates(d)))
query("j15_date_differences", "SELECT r.id, list_filter([CASE WHEN r.taken IS DISTINCT FROM m.date_taken_ms THEN 'TAKEN' END, CASE WHEN r.added IS DISTINCT FROM m.date_added_sec THEN 'ADDED' END, CASE WHEN r.modified IS DISTINCT FROM m.date_modified_sec THEN 'MODIFIED' END], lambda x: x IS NOT NULL) AS labels FROM journal r JOIN media m ON m.uri = r.media_uri")(
    lambda d: _dated(d).select("id", lifecycle.date_differences(F.col("e"), F.col("f")).alias("labels"))
)
query("t6_recovery", "SELECT r.id, CASE WHEN r.pos % 7 = 0 THEN 'FAILED' WHEN r.taken = m.date_taken_ms AND r.added = m.date_added_sec THEN 'RECOVERED' WHEN r.pos % 2 = 0 AND r.taken = m.date_taken_ms THEN 'RECOVERED' ELSE 'DATES_PENDING' END AS outcome FROM journal r JOIN media m ON m.uri = r.media_uri")(
    lambda d: _dated(d).select("id", lifecycle.recovery_outcome(F.col("pos") % 7 != 0, lifecycle.date_differences(F.col("e"), F.col("f")), F.col("pos") % 2 == 0).alias("outcome"))
)
query("t3_restored", "SELECT id FROM ledger WHERE media_store_id % 4 <> 0")(lambda d: lifecycle.restored(d.ledger(), d.attempts().withColumn("outcome", F.when(F.col("seq") % 4 == 0, "RESTORED").otherwise("FAILED"))).select("id"))

_TIERS = {"photo_tier": "BALANCED", "live_tier": "COMPACT", "live_video_tier": "BALANCED", "video_tier": "HIGH"}


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _filter_counts(todo: DataFrame) -> DataFrame:
    return _stack([selection.todo_filter(todo, f).agg(F.count("*").alias("n")).select(F.lit(f).alias("f"), "n") for f in ("skip", "photo", "live", "video", "all")])


def _names(d: Driver, *names: str) -> DataFrame:
    return d.spark.createDataFrame([(n,) for n in names], "bucket_name string")


def _todo_badge() -> Column:
    reason = F.coalesce("skip_reason", F.lit(""))
    return views.todo_badge(reason.startswith("DATES"), reason == "RECOVERY_PENDING", F.col("skip_reason").isNull(), F.col("kind"))


def _live_dates(d: Driver) -> DataFrame:
    rows = d.library().by_path.select("data_path", "item.*")
    return rows.select("data_path", "id", "date_added_sec", "date_modified_sec", "date_taken_ms", (F.col("date_modified_sec") + F.col("id") % 2).alias("mtime_sec"))


def _dated(d: Driver) -> DataFrame:
    names = ("taken", "added", "modified")
    e = d.journal().select("id", "pos", F.col("media_uri").alias("uri"), F.struct(*names).alias("e"))
    f = d.media().select("uri", F.struct(*[F.col(c).alias(n) for c, n in zip(("date_taken_ms", "date_added_sec", "date_modified_sec"), names, strict=True)]).alias("f"))
    return e.join(f, "uri")


def queries() -> dict[str, Callable]:
    """For the driver contract: name -> function of (spark, sf_dir)."""
    return {name: (lambda spark, sf_dir, f=f: f(Driver(spark, sf_dir))) for name, f in QUERIES.items()}
