"""Rows built for the ledger, single rows, journal writes, rebuilt multi-picture files, batch texts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.functions import containers as C
from shoebox.functions import fmt
from shoebox.operators import catalog, lifecycle
from shoebox.sources import files, journal

from .test_containers import SCAN, mpf, seg
from .test_views import media


def test_ledger_rows(spark):
    items = spark.createDataFrame([media(1), media(2)], schemas.MEDIA)
    attempts = spark.createDataFrame([("image:1", "DONE", 600, "s", "r-1", "JPEG q85"), ("image:2", "SKIPPED", None, None, None, None), ("image:3", "FAILED", 1, "s", "r", "x")], "key string, outcome string, new_size long, sha string, ledger_id string, codec string")
    rows = {r.status: r for r in lifecycle.ledger_rows(attempts, items, 1000).collect()}
    done, skipped = rows["DONE"], rows["SKIPPED"]
    assert len(rows) == 2 and done.id == "r-1" and done.restore_deadline_ms == 1000 + 30 * 86_400_000 and done.backup_rel_path == "r-1/1.jpg" and (done.original_size, done.compressed_size) == (1024, 600)
    assert skipped.compressed_size == 1024 and skipped.backup_rel_path is None and skipped.restore_deadline_ms == 0 and skipped.id[14] == "3"
    assert [c for c in lifecycle.ledger_rows(attempts, items, 1).columns] == [f.split()[0] for f in schemas.LEDGER.replace("\n", " ").split(", ")]


def test_single_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, x string")
    assert tuple(catalog.exactly_one(df.filter("id = 1"), "row").first()) == (1, "a") and catalog.at_most_one(df.filter("id = 9"), "row").count() == 0
    for f, condition in ((catalog.exactly_one, "id = 2"), (catalog.exactly_one, "id = 9"), (catalog.at_most_one, "id = 2")):
        with pytest.raises(PySparkException):
            f(df.filter(condition), "row").collect()


def test_journal_begin(spark, tmp_path):
    entry = {"id": "a-1", "path": "/p", "backup": "k", "sha256": "s", "mtime": "2024-01-01T00:00:00.1Z", "uri": "u", "taken": None, "added": 2, "modified": 3}
    (tmp_path / "j").mkdir()
    journal.begin(spark, f"{tmp_path}/j", entry)
    assert journal.read(spark, f"{tmp_path}/j").first().media_uri == "u"
    with pytest.raises(ValueError):
        journal.begin(spark, f"{tmp_path}/j", entry | {"id": "../x"})


@pytest.mark.parametrize("bad", ["", "/a", "../a", "a/../b", "a//b", "."])
def test_safe_path(bad):
    assert files.safe_path("/r/", "a/b") == "/r/a/b"
    with pytest.raises(ValueError):
        files.safe_path("/r", bad)


def test_mpf_rebuild():
    other = b"\xff\xd8" + SCAN
    xmp = '<Container:Item Item:Semantic="Primary" Item:Length="9"/>'
    head = b"\xff\xd8" + seg(0xE1, C.XMP + xmp.encode())
    make = lambda size, offset: head + seg(0xE2, mpf([(0, size, 0, 0, 0), (0, len(other), offset, 0, 0)])) + SCAN
    size = len(make(1, 0))
    original = make(size, size - len(head) - 8) + other
    assert C.mpf_plan(original) is not None
    encoded = b"\xff\xd8" + seg(0xDB, b"q" * 300) + SCAN
    out = C.mpf_rebuild(original, encoded, xmp)
    end, others = C.mpf_plan(out)
    assert out.endswith(other) and others == [(len(out) - len(other), len(other))] and f'Item:Length="{end}"' in C.xmp_text(out)
    assert C.mpf_rebuild(encoded, encoded, xmp) is None


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(fmt.codec_text(F.lit("JPEG"), F.lit(85), F.lit(16))) == "JPEG q85, from 16 bit" and one(fmt.codec_text(F.lit("JPEG"), F.lit(85), F.lit(8), F.lit("gain map"))) == "JPEG q85, gain map"
    assert one(fmt.outcome_text(F.lit(3), F.lit(0), F.lit(1), F.lit(4 << 30), F.array(F.lit("a"), F.lit("b")))) == "3 done, saved 4GB, 1 failed, a; b"
    assert one(fmt.progress(F.lit(1), F.lit(0))) == 0 and one(fmt.progress(F.lit(1), F.lit(2))) == 0.5
