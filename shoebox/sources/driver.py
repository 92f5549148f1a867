"""Media relations derived from the driver's star-schema tables.

The mapping is this repository's own (the tables hold no media). It is written in SQL that
Spark and DuckDB both read, so that oracles derive their inputs alike; what the engine does
with the relations is not shared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import catalog

NOW_MS = 1_700_000_000_000
EXCLUDED = "album_3\nalbum_7\n \nalbum_11"

RAW = """
SELECT k AS id, k % 7 = 0 AS is_video, k % 97 = 0 AS is_trashed,
  CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN '  '
       WHEN k % 211 IN (2, 3) THEN concat('/m/dup/', CAST(k - k % 211 AS STRING), '.jpg')
       ELSE concat('/m/album_', CAST(c % 23 AS STRING), '/', CAST(k AS STRING), '.', ext) END AS data_path,
  CASE WHEN k % 19 = 0 THEN NULL ELSE 'external_primary' END AS volume_name,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 47 = 0 THEN ' ' ELSE concat('album_', CAST(c % 23 AS STRING)) END AS bucket_name,
  CASE WHEN k % 53 = 0 THEN NULL ELSE concat(CAST(k AS STRING), '.', ext) END AS display_name,
  CASE WHEN k % 23 = 0 THEN NULL
       ELSE CASE ext WHEN 'mp4' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime' WHEN 'mkv' THEN 'video/x-matroska'
       WHEN 'jpg' THEN 'image/jpeg' WHEN 'JPEG' THEN 'image/jpeg' WHEN 'heic' THEN 'image/heic' WHEN 'png' THEN 'image/png'
       WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'bmp' THEN 'image/x-ms-bmp' WHEN 'avif' THEN 'image/avif'
       ELSE 'image/other' END END AS mime_type,
  bytes AS size, CASE WHEN k % 4 = 0 THEN CAST(0 AS BIGINT) ELSE t * 1000 - 5000 END AS date_taken_ms,
  t AS date_added_sec, t + c % 1000 AS date_modified_sec,
  CAST(CASE WHEN k % 31 = 0 THEN 0 ELSE 100 + k % 8000 END AS INT) AS width, CAST(CASE WHEN k % 31 = 0 THEN 0 ELSE 100 + c % 6000 END AS INT) AS height,
  CAST(640 + k % 9 AS INT) AS probe_width, CAST(480 + k % 9 AS INT) AS probe_height, k % 11 = 0 AS has_motion,
  CASE WHEN ext = 'png' AND k % 6 = 0 THEN 'PNG_APNG' END AS png_reason,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'video/avc' ELSE 'video/hevc' END AS video_codec,
  CAST(CASE k % 6 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN -1 WHEN 4 THEN 16 ELSE 18 END AS INT) AS transfer,
  k % 4 = 0 AS ten_bit, CASE WHEN k % 13 = 0 THEN concat('m-', CAST(k AS STRING)) END AS xmp_compress_id
FROM (SELECT *, CASE WHEN k % 7 = 0 THEN CASE k % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mov' ELSE 'mkv' END
  ELSE CASE k % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'heic' WHEN 2 THEN 'png' WHEN 4 THEN 'JPEG'
  ELSE CASE k % 6 WHEN 0 THEN 'gif' WHEN 1 THEN 'webp' WHEN 2 THEN 'dng' WHEN 3 THEN 'bmp' WHEN 4 THEN 'avif' ELSE 'txt' END END END AS ext FROM {base}) b
"""
BASE = "SELECT o_orderkey AS k, o_custkey AS c, {seconds} AS t, CAST(floor(o_totalprice * 100) AS BIGINT) AS bytes FROM {orders}"

LEDGER = """
SELECT concat('r-', CAST(id AS STRING)) AS id, CASE WHEN id % 41 = 0 THEN id + 1 ELSE id END AS media_store_id, data_path,
  CASE WHEN id % 9 = 2 THEN '' WHEN id % 9 = 4 THEN concat(data_path, '.png') ELSE data_path END AS original_path,
  volume_name, bucket_name, display_name, CASE WHEN id % 59 = 0 THEN 'BOGUS' ELSE kind END AS media_kind, mime_type,
  format AS container_format, video_codec, CASE WHEN id % 11 = 0 THEN size + 1 ELSE size END AS original_size,
  CASE WHEN id % 5 = 4 THEN CASE WHEN id % 11 = 0 THEN size + 1 ELSE size END
       ELSE CAST(floor(CAST(size * (40 + id % 70) AS DOUBLE) / 100) AS BIGINT) END AS compressed_size,
  CASE WHEN id % 77 = 0 THEN '' ELSE concat('sha-', CAST(id AS STRING)) END AS original_sha256, date_taken_ms AS original_date_taken_ms,
  date_added_sec AS original_date_added_sec, date_modified_sec AS original_date_modified_sec,
  CASE id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'GENTLE' WHEN 2 THEN 'COMPACT' ELSE 'BALANCED' END AS quality_tier,
  CAST(NULL AS STRING) AS codec_used, date_added_sec * 1000 AS compressed_at_ms,
  {now} + (id % 61 - 30) * 43200000 AS restore_deadline_ms,
  CASE WHEN (id % 5 IN (0, 3) AND id % 4 <> 1) OR (id % 5 = 2 AND id % 2 = 0) OR (id % 5 = 1 AND id % 8 = 0)
       THEN concat('b/', CAST(id AS STRING)) END AS backup_rel_path,
  CASE WHEN id % 5 IN (0, 3) AND id % 4 <> 1 THEN size ELSE CAST(0 AS BIGINT) END AS backup_size,
  CASE WHEN id % 43 = 0 THEN 'FAILED' ELSE CASE id % 5 WHEN 1 THEN 'PURGED' WHEN 2 THEN 'RESTORED' WHEN 4 THEN 'SKIPPED' ELSE 'DONE' END END AS status,
  CAST(NULL AS STRING) AS failure_reason
FROM {media} WHERE id % 3 = 1
"""
JOURNAL = """
SELECT concat('j-', CAST(s AS STRING)) AS id, s AS pos, CASE WHEN s % 10 IN (4, 5) THEN concat(data_path, '.gone') ELSE data_path END AS path,
  concat('b/', CAST(m.id AS STRING)) AS backup, CASE WHEN s % 4 = 0 THEN concat('s/', CAST(m.id AS STRING)) END AS safety, uri AS media_uri,
  CASE WHEN s % 2 = 0 THEN concat(data_path, '.jpg') END AS converted_path, CASE WHEN s % 3 = 0 THEN 'ADDED differs' END AS date_pending_reason,
  date_taken_ms + s % 2 AS taken, date_added_sec + s % 3 AS added, date_modified_sec AS modified
FROM (SELECT s_suppkey AS s FROM {supplier}) q JOIN {media} m ON m.id = s * 37
"""
FILES = """
SELECT path, max(length) AS length, max(sha) AS sha FROM (
  SELECT data_path AS path, CASE id_ % 4 WHEN 0 THEN original_size WHEN 1 THEN compressed_size WHEN 2 THEN original_size ELSE CAST(0 AS BIGINT) END AS length,
         CASE WHEN id_ % 8 = 6 THEN 'other' ELSE original_sha256 END AS sha
  FROM (SELECT *, media_store_id AS id_ FROM {ledger}) a WHERE id_ % 19 <> 0
  UNION ALL
  SELECT backup_rel_path, backup_size + 7, 'backup' FROM {ledger} WHERE backup_rel_path IS NOT NULL AND media_store_id % 9 <> 0
  UNION ALL
  SELECT concat('orphan/', id), CAST(11 AS BIGINT), 'orphan' FROM {ledger} WHERE media_store_id % 50 = 0
) f GROUP BY path
"""
ATTEMPTS = """
SELECT id, media_store_id AS seq, CASE WHEN media_store_id % 997 = 0 AND media_store_id > 0 THEN 'FAILED' WHEN media_store_id % 6 = 1 THEN 'SKIPPED' ELSE 'DONE' END AS outcome,
  original_size - compressed_size AS saved, CASE WHEN media_store_id % 6 = 1 THEN concat('NO_GAIN_', CAST(media_store_id % 30 AS STRING)) END AS reason
FROM {ledger}
"""
CACHE_CHANGES = {"data_path": "CASE WHEN id % 29 = 0 THEN concat(data_path, '.old') ELSE data_path END", "date_modified_sec": "CASE WHEN id % 17 = 0 THEN date_modified_sec - 5 ELSE date_modified_sec END"}


#: Folders of stored relations, by application, directory and name: what the views of one query need is there for the
#: next one's.
_STORED: dict[tuple[str, str, str], str] = {}


class Driver:
    """Relations over the tables of one directory, which must not change while a session uses them; nothing
    is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw(self) -> DataFrame:
        base = self.spark.sql(BASE.format(seconds="unix_timestamp(o_orderdate)", orders="{orders}"), orders=self.table("orders"))
        return self.spark.sql(RAW, base=base)

    def media(self) -> DataFrame:
        return catalog.to_media(self.raw())

    def media_all(self) -> DataFrame:
        """Trashed rows included, as an older snapshot had them."""
        return catalog.to_media(self.raw().drop("is_trashed").selectExpr("*", "false AS is_trashed"))

    def cache(self) -> DataFrame:
        rows = self.media_all().filter("id % 10 <> 3")
        return rows.selectExpr(*[f"{CACHE_CHANGES[c]} AS {c}" if c in CACHE_CHANGES else c for c in rows.columns])

    def ledger(self) -> DataFrame:
        return self.spark.sql(LEDGER.replace("{now}", str(NOW_MS)), media=self.media_all())

    def journal(self) -> DataFrame:
        return self.spark.sql(JOURNAL, supplier=self.table("supplier"), media=self.media_all())

    def files(self) -> DataFrame:
        return self.spark.sql(FILES, ledger=self.ledger())

    def attempts(self) -> DataFrame:
        return self.spark.sql(ATTEMPTS, ledger=self.ledger())

    def settings(self, **changes) -> DataFrame:
        row = schemas.FRESH_SETTINGS | {"excluded_albums": EXCLUDED} | changes
        return self.spark.createDataFrame([row], schemas.SETTINGS)

    def workspace(self) -> str:
        """A new folder in the cluster's shared one; where none is set, in this machine's, if Spark is local."""
        root = self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not self.spark.conf.get("spark.master", "local").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="shoebox-")
        return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a written table, once for each application, directory and name; again where it was removed."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _STORED or not self.exists(f"{_STORED[key]}/_SUCCESS"):
            at = self.workspace()
            df.write.parquet(at)
            _STORED[key] = at
        return self.spark.read.schema(df.schema).parquet(_STORED[key])

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def folder(self, path: str) -> str:
        """``path``, where there is a folder now."""
        fs, p = self._at(path)
        fs.mkdirs(p)
        return path

    def remove(self, path: str) -> None:
        """Remove a folder of a ``workspace`` with all that is in it."""
        fs, p = self._at(path)
        fs.delete(p, True)

    def library(self, **settings):
        """Views over stored tables: each derived relation is written once and read as often as the views need."""
        from ..operators.views import Library

        media, ledger, journal = (self.stored(name, getattr(self, name)()) for name in ("media", "ledger", "journal"))
        return Library(media, ledger, journal, self.settings(**settings), store=self.stored)
