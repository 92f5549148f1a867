"""Queries over texts, rules and rows that are built: their inputs are made from columns of the tables, and the
oracles compute the results from the same columns in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..functions import media as M
from ..functions import xmp as X
from ..operators import catalog, layout, ledger, lifecycle, selection, views
from ..sources import files
from ..sources.driver import NOW_MS, Driver
from .registry import query

def numbers(d: Driver) -> DataFrame:
    return d.table("orders").select(F.col("o_orderkey").alias("k"))


_N = ", n AS (SELECT o_orderkey AS k FROM orders) "

# Sizes are odd, so that no rounding is a tie.
_SIZE = "CASE k % 4 WHEN 0 THEN k % 2048 * 2 - 99 WHEN 1 THEN k * 514 + 1 WHEN 2 THEN k * 70002 + 1 ELSE k * 3000002 + 1 END"
_UNITS = "CASE WHEN s < 0 THEN '0 B' WHEN s >= 1073741824 THEN printf('%.2f GB', s / 1073741824::DOUBLE) WHEN s >= 1048576 THEN printf('%.1f MB', s / 1048576::DOUBLE) WHEN s >= 1024 THEN printf('%.0f KB', s / 1024::DOUBLE) ELSE s || ' B' END"
_COMPACT = "CASE WHEN contains(t, '.') THEN rtrim(rtrim(split_part(t, ' ', 1), '0'), '.') ELSE split_part(t, ' ', 1) END || split_part(t, ' ', 2)"
query("f13_f14_sizes", _N + f"SELECT k, t AS size, {_COMPACT} AS compact FROM (SELECT k, {_UNITS} AS t FROM (SELECT k, {_SIZE} AS s FROM n))")(
    lambda d: numbers(d).select("k", F.expr(_SIZE).cast("long").alias("s")).select("k", fmt.format_size(F.col("s")).alias("size"), fmt.format_compact_size(F.col("s")).alias("compact"))
)
query("f15_counts", _N + "SELECT k, format('{:,}', k * 1003) AS text FROM n")(lambda d: numbers(d).select("k", fmt.format_count(F.col("k") * 1003).alias("text")))
query("f16_date_time", "SELECT key, CASE WHEN id % 9 = 0 THEN 'UNKNOWN' ELSE strftime(make_timestamp(date_taken_ms * 1000), '%Y-%m-%d %H:%M') END AS text FROM media")(
    lambda d: d.media().select("key", fmt.format_date_time(F.when(F.col("id") % 9 == 0, F.lit(0)).otherwise(F.col("date_taken_ms"))).alias("text"))
)
query(
    "f18_counts_by_kind",
    _N + "SELECT k, coalesce(nullif(concat_ws(', ', CASE WHEN k % 3 > 0 THEN 'photo ' || k % 3 END, CASE WHEN k % 4 > 0 THEN 'live ' || k % 4 END, CASE WHEN k % 5 > 0 THEN 'video ' || k % 5 END), ''), 'none') AS text FROM n",
)(lambda d: numbers(d).select("k", fmt.enumerate_counts(F.col("k") % 3, F.col("k") % 4, F.col("k") % 5).alias("text")))
_ALBUM_LINES = f""", a AS (SELECT bucket_name, count(*) AS n, count(*) FILTER (NOT adopted AND NOT skipped) AS known, sum(original_size)::BIGINT AS b, sum(compressed_size)::BIGINT AS e,
    sum(CASE WHEN adopted THEN 0 ELSE greatest(saved, 0) END)::BIGINT AS sv, count(*) FILTER (restorable) AS r, bool_and(skipped) AS every FROM done GROUP BY bucket_name),
  f AS (SELECT *, {_UNITS.replace("s ", "b ").replace("s /", "b /")} AS bt, {_UNITS.replace("s ", "e ").replace("s /", "e /")} AS et, {_UNITS.replace("s ", "sv ").replace("s /", "sv /")} AS t FROM a)
  SELECT bucket_name, CASE WHEN r > 0 THEN 'restorable ' || format('{{:,}}', r) ELSE 'not restorable' END AS status,
    format('{{:,}}', n) || ' items · ' || CASE WHEN known = 0 THEN et ELSE bt || ' → ' || et END AS sizes,
    format('{{:,}}', n) || ' items · ' || CASE WHEN known > 0 OR every THEN '-' || {_COMPACT} ELSE '—' END AS savings FROM f"""
query("f19_album_lines", _ALBUM_LINES)(
    lambda d: d.library()
    .done_albums()
    .select(
        "bucket_name",
        fmt.status_line(F.col("restorable_count")).alias("status"),
        fmt.size_line(F.col("count"), F.col("before"), F.col("after"), F.col("known_before_count")).alias("sizes"),
        fmt.savings_line(F.col("count"), F.col("saved"), F.col("known_before_count"), F.col("all_skipped")).alias("savings"),
    )
)
query(
    "f29_codec_text",
    "SELECT key, format || ' q' || id % 100 || CASE WHEN id % 2 = 0 THEN ', from 16 bit' ELSE '' END || CASE WHEN id % 3 = 0 THEN ', gain map' ELSE '' END AS text FROM media",
)(lambda d: d.media().select("key", fmt.codec_text(F.col("format"), F.col("id") % 100, F.when(F.col("id") % 2 == 0, 16).otherwise(8), F.when(F.col("id") % 3 == 0, "gain map")).alias("text")))
query(
    "f30_memory_estimates",
    """SELECT key, width::BIGINT * height * 4 + size * 6 + 67108864 AS heic,
      ((width::BIGINT * p + 63) // 64 * 64) * height + size * 2 + greatest(width::BIGINT * ch * b * 2, width::BIGINT * 4) + id % 1000 * 4 + 33554432 AS png
    FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 8 ELSE 4 END AS p, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS b, 1 + id % 4 AS ch FROM media)""",
)(
    lambda d: d.media().select(
        "key",
        fmt.memory_estimate_heic(F.col("width"), F.col("height"), F.col("size")).alias("heic"),
        fmt.memory_estimate_png(F.col("width").cast("long"), F.col("height").cast("long"), F.when(F.col("id") % 2 == 0, 16).otherwise(8), 1 + F.col("id") % 4, F.col("size"), F.col("id") % 1000).alias("png"),
    )
)
query(
    "f31_outcome_text",
    _N + "SELECT k, concat_ws(', ', CASE WHEN k % 2 > 0 THEN '1 done' END, CASE WHEN k % 3 > 0 THEN 'saved ' || k % 3 || 'B' END, CASE WHEN k % 5 > 0 THEN k % 5 || ' skipped' END, CASE WHEN k % 7 > 0 THEN k % 7 || ' failed' END, CASE WHEN k % 2 = 0 THEN 'a; r' || k % 9 END) AS text FROM n",
)(lambda d: numbers(d).select("k", fmt.outcome_text(F.col("k") % 2, F.col("k") % 5, F.col("k") % 7, F.col("k") % 3, F.when(F.col("k") % 2 == 0, F.array(F.lit("a"), F.concat(F.lit("r"), (F.col("k") % 9).cast("string")))).otherwise(F.array().cast("array<string>"))).alias("text")))
query("f33_progress", _N + "SELECT k, CASE WHEN k % 10 > 0 THEN CAST((k % 7)::DOUBLE / (k % 10) AS FLOAT) ELSE CAST(0 AS FLOAT) END AS share FROM n")(lambda d: numbers(d).select("k", fmt.progress(F.col("k") % 7, F.col("k") % 10).alias("share")))
query("f34_marker", _N + "SELECT k, 'id-' || k AS id, '2.1' AS version, k * 3 AS time_ms FROM n")(
    lambda d: numbers(d)
    .select("k", X.marker(F.concat(F.lit("id-"), F.col("k").cast("string")), F.lit("2.1"), F.col("k") * 3).alias("m"))
    .select("k", X.read_marker(X.inject_marker(F.lit(None).cast("string"), F.col("m"))).alias("r"))
    .select("k", "r.id", "r.version", "r.time_ms")
)
query("o5_message_lines", _N + "SELECT k, CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a\nb' ELSE 'a\nb\n' || k END AS text FROM n")(
    lambda d: numbers(d).select("k", selection.message_lines(F.concat(F.lit(" a \n\n"), F.when(F.col("k") % 3 > 0, "b\na\n").otherwise(""), F.when(F.col("k") % 3 == 2, F.concat(F.col("k").cast("string"), F.lit("  \nb"))).otherwise("  "))).alias("text"))
)
query(
    "f10_merge_colr",
    """SELECT id, CASE WHEN u THEN ten_bit OR ct IN (16, 18) OR id % 4 = 1 ELSE ten_bit END AS ten_bit, CASE WHEN u THEN ct ELSE pt END AS transfer, CASE WHEN u AND id % 4 = 1 THEN 6 ELSE 1 END AS standard
    FROM (SELECT *, coalesce(format = 'MP4' AND video_codec IS NOT NULL AND pt < 0 AND ct >= 0, false) AS u FROM (SELECT m.*, r.ten_bit, CASE WHEN r.id % 3 = 0 THEN 3 ELSE -1 END AS pt, CASE r.id % 5 WHEN 0 THEN -1 WHEN 1 THEN 16 WHEN 2 THEN 18 ELSE 1 END AS ct FROM media m JOIN raw r ON r.id = m.id AND r.is_video = m.is_video))""",
)(
    lambda d: d.media()
    .join(d.raw().select("id", "is_video", "ten_bit"), ["id", "is_video"])
    .select(
        "id",
        M.merge_colr(
            F.col("format"),
            F.col("video_codec"),
            F.struct("ten_bit", F.when(F.col("id") % 3 == 0, 3).otherwise(-1).alias("transfer"), F.lit(1).alias("standard")),
            F.struct(F.when(F.col("id") % 5 == 0, -1).when(F.col("id") % 5 == 1, 16).when(F.col("id") % 5 == 2, 18).otherwise(1).alias("transfer"), F.when(F.col("id") % 4 == 1, 9).otherwise(1).alias("primaries")),
        ).alias("m"),
    )
    .select("id", "m.ten_bit", "m.transfer", "m.standard")
)

# Rules.
query("p12_needs_full_scan", _N + "SELECT k, k % 3 = 0 OR k % 6 <> 4 AS need FROM n")(lambda d: numbers(d).select("k", catalog.needs_full_scan(F.col("k") % 3, F.col("k") % 6).alias("need")))
_REASONS = ("ADDED differs", "ADDED and TAKEN differ", "TAKEN differs", "MODIFIED, ADDED", "ADDED", "ADDED, MODIFIED")
query("p33_can_keep_added", _N + "SELECT k, k % 7 IN (0, 4) AS can FROM n")(
    lambda d: numbers(d).select("k", lifecycle.can_keep_added(F.get(F.array(*map(F.lit, _REASONS)), (F.col("k") % 7).cast("int"))).alias("can"))
)
query("p34_row_usable", _N + "SELECT k, k % 3 = 0 AND (k % 4 = 0 OR (k % 4 = 1 AND k % 5 = 0)) AS usable FROM n")(
    lambda d: numbers(d).select("k", lifecycle.row_usable(F.when(F.col("k") % 3 == 2, -1).otherwise(F.col("k") % 3), F.when(F.col("k") % 4 == 3, -1).otherwise(F.col("k") % 4), F.when(F.col("k") % 5 == 0, "me").when(F.col("k") % 5 == 1, "you"), "me").alias("usable"))
)
query("p36_safe_paths", _N + "SELECT k, k % 8 IN (0, 1) AS safe FROM n")(
    lambda d: numbers(d).select("k", files.is_safe(F.concat(F.get(F.array(*map(F.lit, ("a", "a/b", "../a", "a/../b", "a//b", "/a", "a/.", "./a"))), (F.col("k") % 8).cast("int")), F.when(F.col("k") % 8 == 6, "").otherwise(F.col("k").cast("string")))).alias("safe"))
)
query("p23_shown_albums", "SELECT bucket_name FROM todo GROUP BY bucket_name HAVING count(*) FILTER (skip_reason IS NULL) > 0 OR count(*) FILTER (skip_reason = 'RECOVERY_PENDING' OR starts_with(skip_reason, 'DATES_PENDING')) > 0")(
    lambda d: views.shown_albums(d.library().todo_albums()).select("bucket_name")
)
query("a19_exclusion_counts", "SELECT 3 AS hidden, count(DISTINCT bucket_name) AS albums FROM media")(lambda d: ledger.exclusion_counts(d.media(), d.settings()))
query("a16_all_selected", "SELECT id, bucket_name IN ('album_1', 'album_2') AS every FROM media")(
    lambda d: d.media().select("id", selection.all_selected(F.array("bucket_name"), F.array(F.lit("album_1"), F.lit("album_2"))).alias("every"))
)
query("s19_live_row", "SELECT id, data_path, size, mime_type FROM raw WHERE id = 1")(lambda d: catalog.exactly_one(d.raw().filter("id = 1"), "row").select("id", "data_path", "size", "mime_type"))
query("s20_path_lookup", "SELECT id, is_trashed FROM raw WHERE data_path = (SELECT data_path FROM raw WHERE id = 1)")(
    lambda d: catalog.at_most_one(d.raw().join(F.broadcast(catalog.exactly_one(d.raw().filter("id = 1"), "row").select("data_path")), "data_path", "left_semi"), "path").select("id", "is_trashed")
)

# Lifecycle.
_RESTORES = ", q AS (SELECT media_store_id AS seq, CASE WHEN media_store_id > (SELECT max(media_store_id) * 2 // 3 FROM ledger) AND media_store_id % 3 = 0 THEN 'DATES_PENDING' ELSE 'RESTORED' END AS outcome, original_size - compressed_size AS saved FROM ledger), st AS (SELECT * FROM q WHERE seq <= coalesce((SELECT min(seq) FROM q WHERE outcome <> 'RESTORED'), 9223372036854775807)) "


def _restores(d: Driver) -> DataFrame:
    rows = d.ledger().select(F.col("media_store_id").alias("seq"), (F.col("original_size") - F.col("compressed_size")).alias("saved"))
    late = rows.agg(F.floor(F.max("seq") * 2 / 3).alias("late"))  # one row
    return rows.crossJoin(F.broadcast(late)).select("seq", "saved", F.when((F.col("seq") > F.col("late")) & (F.col("seq") % 3 == 0), "DATES_PENDING").otherwise("RESTORED").alias("outcome"))


query(
    "a11_restore_counters",
    _RESTORES + "SELECT count(*) FILTER (outcome = 'RESTORED') AS done, coalesce(sum(greatest(saved, 0)) FILTER (outcome = 'RESTORED'), 0)::BIGINT AS added, 0::BIGINT AS failed, count(*) FILTER (outcome = 'DATES_PENDING') AS dates_pending FROM st",
)(lambda d: lifecycle.restore_counters(_restores(d)))


def _outcomes(d: Driver) -> DataFrame:
    """Attempts on all media: (key, outcome, new_size, sha, ledger_id, codec)."""
    i = F.col("id")
    outcome = F.when(i % 4 == 0, "SKIPPED").when(i % 4 == 3, "FAILED").otherwise("DONE")
    return d.media().select("key", outcome.alias("outcome"), F.floor(F.col("size") / 2).alias("new_size"), F.concat(F.lit("sha-"), "key").alias("sha"), F.concat(F.lit("new-"), "key").alias("ledger_id"), F.lit("JPEG q85").alias("codec"))


_ROWS = f"""SELECT CASE WHEN s THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', position(substr(h, 17, 1) IN '0123456789abcdef'), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) ELSE 'new-' || key END AS id,
  id AS media_store_id, data_path, size AS original_size, CASE WHEN s THEN size ELSE size // 2 END AS compressed_size, CASE WHEN s THEN 0 ELSE {NOW_MS} + 2592000000 END AS restore_deadline_ms,
  CASE WHEN NOT s THEN 'new-' || key || '/' || display_name END AS backup_rel_path, CASE WHEN s THEN 0 ELSE size END AS backup_size, CASE WHEN s THEN 'SKIPPED' ELSE 'DONE' END AS status, CASE WHEN NOT s THEN 'JPEG q85' END AS codec_used
  FROM (SELECT *, id % 4 = 0 AS s, md5('skip:' || volume_name || ':' || id || ':' || data_path) AS h FROM media WHERE id % 4 <> 3)"""
_LEDGER_ROW = ("id", "media_store_id", "data_path", "original_size", "compressed_size", "restore_deadline_ms", "backup_rel_path", "backup_size", "status", "codec_used")
query("p35_f25_ledger_rows", _ROWS)(lambda d: lifecycle.ledger_rows(_outcomes(d), d.media(), NOW_MS).select(*_LEDGER_ROW))


def _published(d: Driver) -> DataFrame:
    fresh = lifecycle.ledger_rows(_outcomes(d), d.media(), NOW_MS)
    failed = d.ledger().withColumn("outcome", F.lit("FAILED"))  # attempts that leave no trace
    return lifecycle.publish(d.ledger(), fresh.withColumn("outcome", F.col("status")).unionByName(failed)).select(*_LEDGER_ROW)


query("t1_t2_publish", _ROWS + " UNION ALL SELECT id, media_store_id, data_path, original_size, compressed_size, restore_deadline_ms, backup_rel_path, backup_size, status, codec_used FROM ledger")(_published)


# Names of new files.
def _wanted(d: Driver) -> DataFrame:
    return numbers(d).select(F.concat(F.lit("/d"), (F.col("k") % 50).cast("string")).alias("directory"), F.concat(F.lit("n"), (F.col("k") % 3).cast("string"), F.lit(".png")).alias("name"), F.col("k").alias("seq"))


def _existing(d: Driver) -> DataFrame:
    names = F.explode(F.array(F.lit("n0.jpg"), F.lit("n1_2.jpg"), F.lit("n2_x.jpg")))
    return _wanted(d).select("directory").distinct().select("directory", names.alias("name"))


query(
    "f28_destinations",
    _N + """SELECT directory, name, seq, 'n' || b || CASE WHEN number = 0 THEN '' ELSE '_' || number END || '.jpg' AS destination FROM (
      SELECT *, CASE b WHEN 0 THEN r WHEN 1 THEN CASE WHEN r - 1 < 2 THEN r - 1 ELSE r END ELSE r - 1 END AS number FROM (
        SELECT '/d' || k % 50 AS directory, 'n' || k % 3 || '.png' AS name, k AS seq, k % 3 AS b, row_number() OVER (PARTITION BY k % 50, k % 3 ORDER BY k) AS r FROM n))""",
)(lambda d: layout.unique_destinations(_wanted(d), _existing(d)))
