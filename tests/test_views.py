"""Views over small hand-made libraries."""

from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.operators import ledger as L
from shoebox.operators.views import Library

MEDIA = dict(is_video=False, volume_name="external_primary", bucket_name="Camera", mime_type="image/jpeg", size=1024, date_taken_ms=1000, date_added_sec=1, date_modified_sec=1, width=100, height=100, kind="PHOTO", format="JPEG", skip_reason=None, video_codec=None, xmp_compress_id=None)
RECORD = dict(media_store_id=1, original_path="", volume_name="external_primary", bucket_name="Camera", display_name="1.jpg", media_kind="PHOTO", mime_type="image/jpeg", container_format="JPEG", video_codec=None, original_size=2048, compressed_size=1024, original_sha256="s", original_date_taken_ms=1000, original_date_added_sec=1, original_date_modified_sec=1, quality_tier="BALANCED", codec_used=None, compressed_at_ms=2000, restore_deadline_ms=2**63 - 1, backup_rel_path="record-1/1.jpg", backup_size=1024, status="DONE", failure_reason=None)
JOURNAL = "id string, pos string, path string, backup string, safety string, media_uri string, converted_path string, date_pending_reason string, taken long, added long, modified long"


def media(i, **changes):
    row = MEDIA | {"id": i, "key": f"image:{i}", "uri": f"content://media/external/images/media/{i}"} | changes
    return row | {"data_path": changes.get("data_path", f"/s/{row['bucket_name']}/{i}.jpg"), "display_name": f"{i}.jpg"}


def library(spark, items=(), records=(), journal=(), **settings):
    table = lambda rows, schema: spark.createDataFrame([dict(r) for r in rows], schema)
    return Library(table(items, schemas.MEDIA), table([RECORD | r for r in records], schemas.LEDGER), table(journal, JOURNAL), table([schemas.FRESH_SETTINGS | settings], schemas.SETTINGS))


def entry(path="/s/Camera/1.jpg", **changes):
    return dict(id="e", pos="e", path=path, backup="b", safety=None, media_uri="content://media/external/images/media/1", converted_path=None, date_pending_reason=None, taken=1, added=1, modified=1) | changes


def test_plain_and_marked(spark):
    lib = library(spark, [media(1), media(9, is_video=True, kind="VIDEO", bucket_name="Movies", xmp_compress_id="m")])
    t = lib.totals().first()
    assert (t.todo_count, t.todo_bytes, t.done_count, t.before, t.saved, t.pct) == (1, 1024, 1, 0, 0, 0)
    done = lib.done_albums().first()
    assert (done.bucket_name, done.known_before_count, done.after, done.saved, done.all_skipped) == ("Movies", 0, 1024, 0, False)


def test_exclusion(spark):
    lib = library(spark, [media(1), media(2, bucket_name="Hidden")], excluded_albums="Hidden\n ")
    assert [r.id for r in lib.todo.collect()] == [1] and lib.album_names().count() == 2


def test_png_setting(spark):
    for on, probed in ((False, None), (True, None), (True, "PNG_APNG")):
        lib = library(spark, [media(1, format="PNG", skip_reason=probed)], compress_png=on)
        assert lib.todo.first().skip_reason == (None if on else schemas.PNG_DISABLED)


def test_recycle_list(spark):
    rows = library(spark, records=[{"id": "r", "data_path": "/s/Camera/1.jpg"}])
    assert rows.backups().count() == 1
    gone = L.mark_backups_gone(rows.ledger, spark.createDataFrame([("r",)], "id string"))
    assert gone.filter("status = 'PURGED' AND backup_rel_path IS NULL AND backup_size = 0").count() == 1
    held = library(spark, records=[{"id": "r", "data_path": "/s/Camera/1.jpg"}], journal=[entry()])
    assert held.backups().count() == 0


def test_date_recovery(spark):
    lib = library(spark, [media(1)], [{"id": "r", "data_path": "/s/Camera/1.jpg"}], [entry(date_pending_reason="ADDED")])
    row, album = lib.todo.first(), lib.todo_albums().first()
    assert row.skip_reason == "DATES_PENDING:ADDED" and (album.compressible_count, album.pending_count) == (0, 1) and lib.done.count() == 0


def test_skipped_rows_follow_their_file(spark):
    record = {"id": "r", "data_path": "/s/Camera/1.jpg", "status": "SKIPPED", "original_size": 1024, "compressed_size": 1024, "backup_rel_path": None}
    for change, active in (({}, 1), ({"size": 7}, 0), ({"date_modified_sec": 9}, 0), ({"volume_name": "sd"}, 0), ({"xmp_compress_id": "m"}, 0)):
        assert library(spark, [media(1, **change)], [record]).active.count() == active
    assert library(spark, [], [record]).active.count() == 0


def test_journal_by_uri_and_missing(spark):
    converted = entry("/s/Camera/old.png", converted_path="/s/Camera/new.jpg")
    lib = library(spark, [media(1)], journal=[converted])
    assert lib.todo.first().skip_reason == schemas.RECOVERY_PENDING and lib.missing.count() == 0
    lost = library(spark, [], journal=[entry("/s/Gone/x.jpg", media_uri="content://media/external/video/media/abc", id="q")]).missing.first()
    assert lost.bucket_name == "Gone" and lost.kind == "VIDEO" and lost.format == "MP4" and lost.id < 0 and lost.size == 0


def test_last_item_of_a_path(spark):
    lib = library(spark, [media(1, data_path="/p", size=1), media(2, data_path="/p", size=2, date_added_sec=0)], [{"id": "r", "data_path": "/p"}])
    assert lib.done.first().item_size == 2


def test_savings_are_clamped_two_ways(spark):
    records = [{"id": "a", "data_path": "/a", "original_size": 10, "compressed_size": 4}, {"id": "b", "data_path": "/b", "original_size": 10, "compressed_size": 15}]
    lib = library(spark, records=records)
    assert lib.done_albums().first().saved == 6 and lib.totals().first().saved == 1


def test_empty(spark):
    lib = library(spark)
    t = lib.totals().first()
    assert (t.todo_count, t.done_count, t.pct) == (0, 0, 0) and {r.kind: r.percent for r in lib.kind_shares().collect()} == dict.fromkeys(schemas.KINDS, 0)


def test_expiry_is_strict(spark):
    rows = library(spark, records=[{"id": "a", "data_path": "/a", "restore_deadline_ms": 5}, {"id": "b", "data_path": "/b", "restore_deadline_ms": 4}]).ledger
    assert [r.id for r in L.expired(rows, 5).collect()] == ["b"]
    assert L.upsert(rows, rows.filter("id = 'a'").withColumn("status", F.lit("FAILED")), "id").filter("status = 'FAILED'").count() == 1
