"""Versioned tables, the journal, files, streaming."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.operators import ledger as L
from shoebox.sources import files, journal
from shoebox.sources.driver import Driver
from shoebox.sources.tables import Table
from shoebox.streaming import refresh as R

SF = "/root/testdata/sf0.001"


def test_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "id string, n long")
    assert t.read().count() == 0 and t.version() is None
    t.write(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long"))
    first = t.version()
    t.write(L.upsert(t.read(), spark.createDataFrame([("b", 3)], "id string, n long"), "id"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 3)] and t.version() != first
    t.vacuum()
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 3)]


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    """At each step of a write, readers see the version before or the new one; of two writers the second fails."""
    t = Table(spark, f"file://{tmp_path}/t", "n long")
    rows = lambda n: spark.range(n).selectExpr("id AS n")
    t.write(rows(3), tag="7")
    seen, real = [], t._fs

    class Steps:
        def __getattr__(self, name):
            def step(*args):
                seen.append((name, Table(spark, t.path, "n long").read().count()))
                out = getattr(real, name)(*args)
                seen.append((name, Table(spark, t.path, "n long").read().count()))
                return out

            return step

    t._fs = Steps()
    t.write(rows(5))
    assert {n for _, n in seen} == {3, 5} and [n for _, n in seen] == sorted(n for _, n in seen) and ("rename", 3) in seen and ("rename", 5) in seen
    t._fs = real
    late = Table(spark, t.path, "n long")
    names = late._pointers()
    monkeypatch.setattr(late, "_pointers", lambda: names[:-1])
    with pytest.raises(OSError):
        late.write(rows(9))
    assert t.read().count() == 5 and t.tag() == ""


def test_migration(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/s", schemas.SETTINGS, "settings")
    t.write(spark.createDataFrame([(1, "HIGH", "HIGH", "HIGH")], "id int, photo_tier string, live_tier string, video_tier string"), schema_version=1)
    row = t.read().first()
    assert row.excluded_albums == "" and row.compress_png is False and row.live_video_tier == "BALANCED" and row.cache_logic_version == 0
    assert schemas.FRESH_SETTINGS["compress_png"] is True
    R.ScanMark(t).run(lambda: None, 77)
    assert (t.read().first().last_scan_sec, t.read().first().cache_logic_version, t.read().first().photo_tier) == (77, 4, "HIGH")


def test_journal(spark, tmp_path):
    assert journal.read(spark, f"{tmp_path}/none").count() == 0
    full = {"id": "b-1", "path": "/p", "backup": "k", "sha256": "s", "mtime": "2024-01-01T00:00:00.123456789Z", "uri": "content://media/external/images/media/1", "taken": 1, "added": 2, "modified": 3}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b-1.json").write_text(json.dumps(full, indent=1))
    (tmp_path / "j" / "a-1.json").write_text(json.dumps(full | {"id": "a-1", "ledgerId": "r", "takenNull": True, "dateRestorePendingReason": "x", "convertedPath": None}))
    a, b = journal.read(spark, f"{tmp_path}/j").orderBy("pos").collect()
    assert (a.ledger_id, a.taken_null, a.date_pending_reason, a.converted_path) == ("r", True, "x", None)
    assert (b.ledger_id, b.taken_null, b.date_pending_reason, b.mtime) == ("b-1", False, None, full["mtime"])
    assert journal.without(journal.read(spark, f"{tmp_path}/j"), "a-1").count() == 1
    journal.finish(spark, f"file://{tmp_path}/j", "a-1")
    journal.finish(spark, f"file://{tmp_path}/j", "never-was")
    assert [r.id for r in journal.read(spark, f"{tmp_path}/j").collect()] == ["b-1"]


def test_files(spark, tmp_path):
    (tmp_path / "r" / "x").mkdir(parents=True)
    (tmp_path / "r" / "x" / "1.jpg").write_bytes(b"a" * 300_000)
    assert {(r.path, r.length) for r in files.listing(spark, f"{tmp_path}/r").collect()} == {("x/1.jpg", 300_000)}
    row = files.with_digest(files.read_bytes(spark, f"{tmp_path}/r")).select(F.length(files.header(F.col("content"))).alias("h"), F.length(files.tail(F.col("content"))).alias("t"), F.length("sha").alias("s")).first()
    assert tuple(row) == (files.HEADER, 300_000, 64)


def test_file_windows_and_backups(spark, tmp_path):
    big = bytes(range(256)) * 12_000
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "v.mp4").write_bytes(big)
    (tmp_path / "m" / "e").write_bytes(b"")
    names = spark.createDataFrame([(f"{tmp_path}/m/v.mp4",), (f"file://{tmp_path}/m/e",), (f"{tmp_path}/none",), (None,)], "path string")
    got = {r.path: r for r in files.windows(names, head=1000, tail=files.TAIL).collect()}
    v = got[f"{tmp_path}/m/v.mp4"]
    assert (v.length, bytes(v["head"]), bytes(v.tail)) == (len(big), big[:1000], big[-files.TAIL :])
    assert got[f"file://{tmp_path}/m/e"].length == 0 and got[f"{tmp_path}/none"].length is None and got[None].length is None
    sources = spark.createDataFrame([("a", f"{tmp_path}/m/v.mp4"), ("b", f"{tmp_path}/none"), ("c", f"{tmp_path}/m/e")], "id string, source string")
    root = f"{tmp_path}/bin"
    for _ in range(2):  # a task that runs again finds its own copy
        done = {r.id: r for r in files.back_up(sources, root).collect()}
        assert (done["a"].outcome, done["a"].length, done["a"].sha) == ("DONE", len(big), hashlib.sha256(big).hexdigest()) and done["b"].outcome == "FAILED" and done["c"].length == 0
    (tmp_path / "m" / "v.mp4").write_bytes(b"other")
    assert files.back_up(sources, root).filter("id = 'a'").first().outcome == "EXISTS" and (tmp_path / "bin" / "a" / "v.mp4").stat().st_size == len(big)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x").write_bytes(b"keep")
    (tmp_path / "bin" / "link").symlink_to(tmp_path / "out")
    gone = spark.createDataFrame([("a/v.mp4",), ("a/none",), ("../m/v.mp4",), ("link/x",), ("",), (None,)], "backup string")
    assert {r.backup: (r.freed, r.outcome) for r in files.delete_backups(gone, root).collect()} == {"a/v.mp4": (len(big), "FREED"), "a/none": (0, "MISSING"), "../m/v.mp4": (0, "REFUSED"), "link/x": (0, "REFUSED"), "": (0, "REFUSED"), None: (0, "REFUSED")}
    assert (tmp_path / "out" / "x").exists() and not (tmp_path / "bin" / "a" / "v.mp4").exists()


def test_stream_equals_batch(spark, tmp_path):
    d = Driver(spark, SF)
    source, view = f"{tmp_path}/in", Table(spark, f"file://{tmp_path}/view", "status string, n long, version long")
    build = lambda rows: rows.groupBy("status").agg(F.count("*").alias("n"))
    rows = d.ledger()
    for version, part in ((1, rows.filter("media_store_id % 2 = 0")), (2, rows)):
        part.withColumn("version", F.lit(version).cast("long")).select("version", *rows.columns).write.mode("append").parquet(source)
        R.refresh(spark, source, f"{tmp_path}/cp", view, build).awaitTermination()
        assert {(r.status, r.n, r.version) for r in view.read().collect()} == {(r.status, r.n, version) for r in build(part).collect()}
    rows.limit(1).withColumn("version", F.lit(1).cast("long")).select("version", *rows.columns).write.mode("append").parquet(source)
    R.refresh(spark, source, f"{tmp_path}/cp", view, build).awaitTermination()
    assert view.read().first().version == 2


def test_empty_views_keep_their_version(spark, tmp_path):
    d = Driver(spark, SF)
    source, view = f"{tmp_path}/in", Table(spark, f"file://{tmp_path}/view", "status string, n long, version long")
    rows = d.ledger()
    for version in (5, 3):
        rows.limit(2).withColumn("version", F.lit(version).cast("long")).select("version", *rows.columns).write.mode("append").parquet(source)
        build = lambda r, v=version: r.groupBy("status").agg(F.count("*").alias("n")).filter(F.lit(v == 3))
        R.refresh(spark, source, f"{tmp_path}/cp", view, build).awaitTermination()
    assert view.read().count() == 0 and view.tag() == "5"


def test_flush(spark, tmp_path):
    d = Driver(spark, SF)
    t = Table(spark, f"file://{tmp_path}/l", schemas.LEDGER, "ledger")
    t.write(d.ledger())
    ids = t.read().filter("backup_rel_path IS NOT NULL").select("id").limit(10)
    R.deal_out(ids.coalesce(1), f"{tmp_path}/ids", most=4)
    R.flush_gone(spark, f"{tmp_path}/ids", f"{tmp_path}/cp", t).awaitTermination()
    before = d.ledger().filter("backup_rel_path IS NOT NULL").count()
    assert t.read().filter("backup_rel_path IS NOT NULL").count() == before - 10 and len(t._pointers()) == 4


def test_expiry_job(spark, tmp_path):
    d = Driver(spark, SF)
    t = Table(spark, f"file://{tmp_path}/l", schemas.LEDGER, "ledger")
    t.write(d.ledger())
    late = L.expired(t.read(), 1_700_000_000_000).count()
    R.expire(t, 1_700_000_000_000)
    assert late > 0 and L.expired(t.read(), 1_700_000_000_000).count() == 0 and t.read().count() == d.ledger().count()
