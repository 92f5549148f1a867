"""The media relations and views once more, in DuckDB SQL, written apart from the engine."""

from __future__ import annotations

from ..sources import driver as D

_BASE = D.BASE.format(seconds="CAST(epoch(o_orderdate) AS BIGINT)", orders="orders")
_MEDIA = """
SELECT CASE WHEN is_video THEN 'video:' ELSE 'image:' END || id AS key, id, is_video,
  'content://media/external/' || CASE WHEN is_video THEN 'video' ELSE 'images' END || '/media/' || id AS uri,
  data_path, volume_name, bucket_name, display_name, mime_type, size,
  CASE WHEN date_taken_ms > 0 THEN date_taken_ms ELSE date_added_sec * 1000 END AS date_taken_ms, date_added_sec, date_modified_sec,
  CASE WHEN is_video AND width <= 0 THEN probe_width ELSE width END AS width, CASE WHEN is_video AND height <= 0 THEN probe_height ELSE height END AS height,
  CASE WHEN is_video THEN 'VIDEO' WHEN format = 'JPEG' AND has_motion THEN 'LIVE_PHOTO' ELSE 'PHOTO' END AS kind, format,
  CASE WHEN is_video THEN CASE WHEN format <> 'MP4' THEN 'CONTAINER_' || format WHEN video_codec IS NULL THEN 'NO_VIDEO_TRACK'
         WHEN transfer IN (6, 16) THEN 'HDR_NO_ENCODER_PQ' WHEN transfer IN (7, 18) THEN 'HDR_NO_ENCODER_HLG' WHEN ten_bit THEN 'HDR_NO_ENCODER_OTHER' END
       WHEN format = 'PNG' AND png_reason IS NOT NULL THEN png_reason
       ELSE CASE format WHEN 'JPEG' THEN NULL WHEN 'HEIC' THEN NULL WHEN 'PNG' THEN NULL WHEN 'BMP' THEN 'BMP_UNSUPPORTED' WHEN 'WEBP' THEN 'WEBP_UNSUPPORTED'
         WHEN 'GIF' THEN 'GIF_UNSUPPORTED' WHEN 'AVIF' THEN 'AVIF_UNSUPPORTED' WHEN 'DNG' THEN 'RAW_UNSUPPORTED' ELSE 'IMAGE_UNKNOWN' END END AS skip_reason,
  CASE WHEN is_video THEN video_codec END AS video_codec, xmp_compress_id, is_trashed
FROM (SELECT * EXCLUDE (format_), format_ AS format FROM (
  SELECT *, CASE WHEN is_video THEN CASE WHEN ext IN ('mp4', 'm4v') THEN 'MP4' WHEN ext = 'mov' THEN 'MOV' WHEN ext = 'mkv' THEN 'MKV' WHEN ext = 'webm' THEN 'WEBM'
      WHEN ext IN ('3gp', '3gpp') THEN 'THREE_GP' WHEN ext IN ('ts', 'm2ts') THEN 'TS' WHEN mime_type = 'video/mp4' THEN 'MP4' WHEN mime_type = 'video/quicktime' THEN 'MOV'
      WHEN mime_type = 'video/webm' THEN 'WEBM' WHEN mime_type = 'video/x-matroska' THEN 'MKV' ELSE 'UNKNOWN' END
    ELSE CASE WHEN mime_type = 'image/jpeg' OR ext IN ('jpg', 'jpeg') THEN 'JPEG' WHEN mime_type IN ('image/heic', 'image/heif') OR ext IN ('heic', 'heif') THEN 'HEIC'
      WHEN mime_type = 'image/png' OR ext = 'png' THEN 'PNG' WHEN mime_type = 'image/webp' OR ext = 'webp' THEN 'WEBP' WHEN mime_type IN ('image/bmp', 'image/x-ms-bmp') OR ext = 'bmp' THEN 'BMP'
      WHEN mime_type = 'image/gif' OR ext = 'gif' THEN 'GIF' WHEN mime_type = 'image/avif' OR ext = 'avif' THEN 'AVIF'
      WHEN ext IN ('dng', 'raw', 'arw', 'cr2', 'nef', 'orf', 'rw2') THEN 'DNG' ELSE 'UNKNOWN' END END AS format_
  FROM (SELECT *, CASE WHEN contains(display_name, '.') THEN lower(split_part(display_name, '.', -1)) ELSE '' END AS ext FROM (
    SELECT * REPLACE (coalesce(display_name, split_part(data_path, '/', -1)) AS display_name, coalesce(mime_type, CASE WHEN is_video THEN 'video/*' ELSE 'image/*' END) AS mime_type,
        coalesce(volume_name, 'external_primary') AS volume_name,
        CASE WHEN trim(bucket_name) <> '' THEN bucket_name WHEN trim(split_part(data_path, '/', -2)) <> '' THEN split_part(data_path, '/', -2) ELSE 'UNNAMED' END AS bucket_name)
    FROM raw WHERE trim(data_path) <> ''))))
"""
_CACHE = "SELECT * EXCLUDE (is_trashed) REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in D.CACHE_CHANGES.items()) + ") FROM media_all WHERE id % 10 <> 3"
_EXCLUDED = "', '".join(x for x in D.EXCLUDED.split("\n") if x.strip())

PRELUDE = f"""
WITH base AS ({_BASE}), raw AS ({D.RAW.format(base="base")}), media_all AS ({_MEDIA}),
media AS (SELECT *, row_number() OVER (ORDER BY is_video, date_added_sec DESC, id) AS ord FROM media_all WHERE NOT is_trashed),
cache AS ({_CACHE}), ledger AS ({D.LEDGER.format(media="media_all", now=D.NOW_MS)}), journal AS ({D.JOURNAL.format(supplier="supplier", media="media_all")}),
files AS ({D.FILES.format(ledger="ledger")}), attempts AS ({D.ATTEMPTS.format(ledger="ledger")}),
jpaths AS (SELECT path FROM journal UNION SELECT converted_path FROM journal WHERE converted_path IS NOT NULL),
reasons AS (SELECT *, coalesce('DATES_PENDING:' || date_pending_reason, 'RECOVERY_PENDING') AS reason FROM journal),
bypath AS (SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY data_path ORDER BY ord DESC) = 1),
hits AS (SELECT m.key, m.data_path, m.ord, r.pos, r.reason FROM media m JOIN reasons r
         ON m.data_path = r.path OR m.data_path = r.converted_path OR (r.converted_path IS NOT NULL AND m.uri = r.media_uri)
         QUALIFY row_number() OVER (PARTITION BY m.key ORDER BY r.pos) = 1),
pending AS (SELECT data_path, reason FROM hits QUALIFY row_number() OVER (PARTITION BY data_path ORDER BY ord DESC) = 1),
active AS (SELECT l.* FROM ledger l LEFT JOIN bypath i USING (data_path)
  WHERE l.status IN ('DONE', 'PURGED', 'SKIPPED') AND l.data_path NOT IN (SELECT path FROM jpaths) AND l.original_path NOT IN (SELECT path FROM jpaths)
    AND (l.status <> 'SKIPPED' OR coalesce(i.id = l.media_store_id AND i.volume_name = l.volume_name AND i.size = l.original_size
         AND i.date_modified_sec = l.original_date_modified_sec AND i.xmp_compress_id IS NULL, false))),
closed AS (SELECT data_path FROM active UNION SELECT data_path FROM media WHERE xmp_compress_id IS NOT NULL
  AND data_path NOT IN (SELECT data_path FROM pending) AND data_path NOT IN (SELECT path FROM jpaths)),
available AS (SELECT m.* REPLACE (CASE WHEN p.reason IS NOT NULL THEN p.reason WHEN m.format = 'PNG' THEN NULL ELSE m.skip_reason END AS skip_reason)
  FROM media m LEFT JOIN pending p USING (data_path) WHERE m.data_path NOT IN (SELECT data_path FROM closed) AND m.bucket_name NOT IN ('{_EXCLUDED}')),
missing AS (SELECT * FROM (SELECT r.*, CASE WHEN trim(split_part(path, '/', -2)) <> '' THEN split_part(path, '/', -2) ELSE 'PENDING_RECOVERY' END AS bucket_name FROM reasons r
  WHERE NOT EXISTS (SELECT 1 FROM media m WHERE m.data_path = r.path OR m.data_path = r.converted_path OR (r.converted_path IS NOT NULL AND m.uri = r.media_uri)))
  WHERE bucket_name NOT IN ('{_EXCLUDED}')),
todo AS (SELECT key, id, bucket_name, size, kind, skip_reason, data_path, width, height, format FROM available
  UNION ALL SELECT 'journal:' || id, CAST(split_part(media_uri, '/', -1) AS BIGINT), bucket_name, 0, CASE WHEN contains(media_uri, '/video/') THEN 'VIDEO' ELSE 'PHOTO' END,
    reason, path, 0, 0, CASE WHEN contains(media_uri, '/video/') THEN 'MP4' ELSE 'UNKNOWN' END FROM missing),
dledger AS (SELECT l.id, l.media_store_id, l.data_path, coalesce(i.bucket_name, l.bucket_name) AS bucket_name,
    CASE WHEN l.media_kind IN ('PHOTO', 'LIVE_PHOTO', 'VIDEO') THEN l.media_kind ELSE 'PHOTO' END AS kind, l.original_size, l.compressed_size,
    CASE WHEN l.quality_tier IN ('HIGH', 'BALANCED', 'COMPACT') THEN l.quality_tier ELSE 'BALANCED' END AS quality_tier, l.restore_deadline_ms, l.backup_rel_path, l.status, i.size AS item_size, false AS adopted
  FROM active l LEFT JOIN bypath i USING (data_path) WHERE coalesce(i.bucket_name, l.bucket_name) NOT IN ('{_EXCLUDED}')),
done AS (SELECT *, CASE WHEN status = 'SKIPPED' THEN 0 ELSE original_size - compressed_size END AS saved, status = 'DONE' AND backup_rel_path IS NOT NULL AS restorable, status = 'SKIPPED' AS skipped FROM (
  SELECT * FROM dledger UNION ALL
  SELECT xmp_compress_id, id, data_path, bucket_name, kind, 0, size, 'BALANCED', 0, NULL, 'DONE', size, true FROM media
  WHERE xmp_compress_id IS NOT NULL AND data_path NOT IN (SELECT data_path FROM dledger) AND bucket_name NOT IN ('{_EXCLUDED}') AND key NOT IN (SELECT key FROM hits)))
"""


def sql(text: str) -> str:
    return PRELUDE + text
