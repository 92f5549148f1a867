"""Classification, texts, ratios."""

import pytest
from pyspark.sql import functions as F

from shoebox.functions import fmt
from shoebox.functions import media as M
from shoebox.operators import catalog, ledger, lifecycle, selection, views
from shoebox.sources.driver import Driver


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("mime", "name", "image", "video"),
    [
        ("image/jpeg", "a", "JPEG", "UNKNOWN"),
        ("", "a.JPG", "JPEG", "UNKNOWN"),
        ("image/heif", "a.x", "HEIC", "UNKNOWN"),
        ("IMAGE/PNG", "a.txt", "UNKNOWN", "UNKNOWN"),
        ("image/x-ms-bmp", "a", "BMP", "UNKNOWN"),
        ("x", "a.b.nef", "DNG", "UNKNOWN"),
        ("video/mp4", "a.mov", "UNKNOWN", "MOV"),
        ("video/quicktime", "noext", "UNKNOWN", "MOV"),
        ("x", "a.3gpp", "UNKNOWN", "THREE_GP"),
        ("x", ".m2ts", "UNKNOWN", "TS"),
        ("video/3gpp", "noext", "UNKNOWN", "UNKNOWN"),
    ],
)
def test_formats(spark, mime, name, image, video):
    row = spark.createDataFrame([(mime, name)], "m string, n string").select(M.image_format(F.col("m"), F.col("n")), M.video_format(F.col("m"), F.col("n"))).first()
    assert tuple(row) == (image, video)


@pytest.mark.parametrize(
    ("size", "text", "compact"),
    [(-1, "0 B", "0B"), (0, "0 B", "0B"), (1023, "1023 B", "1023B"), (1024, "1 KB", "1KB"), (1048575, "1024 KB", "1024KB"), (3 << 19, "1.5 MB", "1.5MB"), (4 << 30, "4.00 GB", "4GB"), (1 << 20, "1.0 MB", "1MB"), (100 << 10, "100 KB", "100KB")],
)
def test_sizes(spark, size, text, compact):
    assert one(spark, fmt.format_size(F.lit(size).cast("long"))) == text
    assert one(spark, fmt.format_compact_size(F.lit(size).cast("long"))) == compact


@pytest.mark.parametrize(("l", "r", "want"), [(67 * 2**30, 301 * 2**10, 0.9999), (30, 10, 0.75), (0, 0, 0.5), (5, 0, 0.9999), (0, 5, 0.0001), (float("nan"), 1, 0.5), (float("inf"), 1, 0.5)])
def test_ratios(spark, l, r, want):
    a, b = fmt.comparison_ratios(F.lit(float(l)), F.lit(float(r)))
    assert abs(one(spark, a) - want) < 1e-6 and abs(one(spark, a) + one(spark, b) - 1) < 1e-6


@pytest.mark.parametrize(("deadline", "days"), [(86_400_000, 1), (86_399_999, 0), (0, 0), (-1, 0), (-86_399_999, 0), (-86_400_000, -1), (2**63 - 1, (2**63 - 1) // 86_400_000)])
def test_days(spark, deadline, days):
    assert one(spark, fmt.days_left(F.lit(deadline).cast("long"), 0)) == days


def test_texts(spark):
    assert one(spark, fmt.format_count(F.lit(1234567))) == "1,234,567"
    assert one(spark, fmt.format_date_time(F.lit(0).cast("long"))) == "UNKNOWN"
    assert one(spark, fmt.format_date_time(F.lit(60_000).cast("long"))) == "1970-01-01 00:01"
    assert one(spark, fmt.enumerate_counts(F.lit(2), F.lit(0), F.lit(1))) == "photo 2, video 1"
    assert one(spark, fmt.enumerate_counts(F.lit(0), F.lit(0), F.lit(0))) == "none"
    assert one(spark, fmt.savings_line(F.lit(3), F.lit(0).cast("long"), F.lit(0), F.lit(False))).endswith("—")
    assert one(spark, fmt.size_line(F.lit(3), F.lit(2048).cast("long"), F.lit(1024).cast("long"), F.lit(1))).endswith("2 KB → 1 KB")
    assert one(spark, fmt.status_line(F.lit(0))) == "not restorable"
    assert one(spark, fmt.estimate_bitrate(F.lit(1920), F.lit(1080), F.lit(30))) == 5598720
    assert one(spark, fmt.choose_bitrate(F.lit(50), F.lit(1920), F.lit(1080), F.lit(30), F.lit("HIGH"), F.lit("STANDARD"), F.lit(True))) == 4758912
    assert one(spark, fmt.memory_estimate_heic(F.lit(10), F.lit(10), F.lit(100))) == 400 + 600 + (64 << 20)
    assert one(spark, fmt.memory_estimate_png(F.lit(10), F.lit(4), F.lit(16), F.lit(4), F.lit(100), F.lit(7))) == 128 * 4 + 200 + 160 + 28 + (32 << 20)


def test_selection_columns(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    none = F.array().cast("array<string>")
    assert one(spark, selection.toggle(a("b", "c"), F.lit("a"))) == ["a", "b", "c"] and one(spark, selection.toggle(a("b", "c"), F.lit("b"))) == ["c"]
    assert one(spark, selection.select_all(a("x", "a"), a("a"))) == ["x"] and one(spark, selection.select_all(a("x"), a("a"))) == ["a", "x"]
    assert not one(spark, selection.all_selected(none, a("a"))) and one(spark, selection.all_selected(a("a"), a("a", "b")))
    assert one(spark, selection.message_lines(F.lit(" a \n\nb\na"))) == "a\nb"
    assert one(spark, ledger.set_album_shown(F.lit("b\n \nc"), F.lit("a"), F.lit(False))) == "a\nb\nc" and one(spark, ledger.set_album_shown(F.lit("b\nc"), F.lit("b"), F.lit(True))) == "c"
    assert one(spark, lifecycle.can_keep_added(F.lit("ADDED differs"))) and not one(spark, lifecycle.can_keep_added(F.lit("ADDED, MODIFIED differ"))) and not one(spark, lifecycle.can_keep_added(F.lit(None).cast("string")))
    for pending, owner, trashed, want in ((0, None, 0, True), (1, "me", 0, True), (1, "you", 0, False), (1, "", 0, False), (1, None, 0, False), (0, None, 1, False), (-1, "me", 0, False), (0, None, -1, False)):
        assert one(spark, lifecycle.row_usable(F.lit(trashed), F.lit(pending), F.lit(owner).cast("string"), "me")) is want


@pytest.mark.parametrize(
    ("cached", "live", "want"),
    [
        ([], [("a", "p", 1, 2)], {"a": "new"}),
        ([("a", "p", 1, 2)], [("a", "p", 1, 2)], {}),
        ([("a", "p", 1, 2)], [("a", "p", 1, 3)], {"a": "changed"}),
        ([("a", "p", 1, 2)], [("a", "q", 1, 2)], {"a": "changed"}),
        ([("a", "p", 1, 2)], [("a", "p", 5, 2)], {"a": "changed"}),
        ([("a", "p", 1, 2)], [], {"a": "removed"}),
        ([("a", "p", 1, 2), ("b", "p", 1, 2)], [("b", "p", 1, 2), ("c", "p", 1, 2)], {"a": "removed", "c": "new"}),
        ([], [], {}),
    ],
)
def test_diff(spark, cached, live, want):
    schema = "key string, data_path string, date_added_sec long, date_modified_sec long"
    assert {r.key: r.change for r in catalog.diff(spark.createDataFrame(cached, schema), spark.createDataFrame(live, schema)).collect()} == want


def test_full_scan_decision():
    assert [catalog.needs_full_scan(*x) for x in ((0, 4), (1, 4), (1, 3), (1, 5))] == [True, False, True, True]


def test_merge_keeps_what_the_probe_lost(spark):
    schema = "key string, n int"
    cached = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], schema)
    got = catalog.merge(cached, spark.createDataFrame([("c",)], "key string"), spark.createDataFrame([("a", 2)], schema))
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 1)]


def test_batch_stops_after_a_failure(spark):
    rows = [(1, "DONE", 5, None), (2, "SKIPPED", 0, "x"), (3, "FAILED", 0, "y"), (4, "DONE", 9, "z")]
    df = spark.createDataFrame(rows, "seq int, outcome string, saved long, reason string")
    assert tuple(lifecycle.batch_counters(df).first()) == (1, 1, 1, 3, 5)
    assert tuple(lifecycle.batch_counters(df.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert [r.reason for r in lifecycle.first_reasons(df, 2).collect()] == ["x", "y"]
    assert tuple(lifecycle.restore_counters(df.withColumn("outcome", F.when(F.col("seq") < 3, "RESTORED").otherwise("DATES_PENDING"))).first()) == (2, 5, 0, 1)


def test_raw_probe_columns(spark):
    d = Driver(spark, "/root/testdata/sf0.001")
    assert d.raw().count() == d.table("orders").count() and "ext" not in d.media().columns
    assert views.ranked(spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "bucket_name string, count long")).orderBy("rank").first().bucket_name == "c"


def test_colour_box_fills_in(spark):
    probe = lambda t: F.struct(F.lit(False).alias("ten_bit"), F.lit(t).alias("transfer"), F.lit(1).alias("standard"))
    colr = F.struct(F.lit(9).alias("primaries"), F.lit(16).alias("transfer"))
    assert tuple(one(spark, M.merge_colr(F.lit("MP4"), F.lit("video/hevc"), probe(-1), colr))) == (True, 16, 6)
    assert tuple(one(spark, M.merge_colr(F.lit("MOV"), F.lit("video/hevc"), probe(-1), colr))) == (False, -1, 1)
    assert tuple(one(spark, M.merge_colr(F.lit("MP4"), F.lit("video/hevc"), probe(3), colr))) == (False, 3, 1)
