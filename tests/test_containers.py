"""Byte parsers on hand-made files."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from shoebox.functions import containers as C
from shoebox.functions import xmp as X


def seg(marker, payload):
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


SCAN = b"\xff\xda\0\3zab\xff\0cd\xff\xd0ef\xff\xd9"


def mpf(entries, order=">"):
    body = (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 2)
    body += struct.pack(order + "HHII", 0xB001, 4, 1, len(entries)) + struct.pack(order + "HHII", 0xB002, 7, 16 * len(entries), 38) + b"\0\0\0\0"
    return C.MPF + body + b"".join(struct.pack(order + "IIIHH", *e) for e in entries)


def test_jpeg_walk_and_end():
    data = b"\xff\xd8" + seg(0xE1, C.EXIF + b"e") + b"\xff" + seg(0xE1, C.XMP + b"<x/>") + SCAN + b"tail"
    segments, tail = C.header_segments(data)
    assert [C.segment_kind(m, p) for _, m, p in segments] == ["EXIF", "XMP"] and data[tail:].startswith(b"\xff\xda")
    assert C.xmp_text(data) == "<x/>" and C.image_end(data) == len(data) - 4
    assert C.image_end(data[:-8]) is None and C.image_end(b"\xff\xd8\xff") is None and C.image_end(b"\xff\xd8\xff\xe0") is None
    progressive = b"\xff\xd8" + SCAN[:-2] + seg(0xC4, b"t") + SCAN
    assert C.image_end(progressive) == len(progressive)


def test_jpeg_rebuild():
    original = b"\xff\xd8" + seg(0xE0, C.JFIF) + seg(0xE1, C.XMP + b"old") + seg(0xDB, b"q") + SCAN
    encoded = b"\xff\xd8" + seg(0xE0, b"other") + seg(0xC0, b"f") + SCAN
    out = C.rebuild(encoded, original, "new", mpf([(0, 1, 0, 0, 0)]))
    kinds = [(C.segment_kind(m, p), m) for _, m, p in C.header_segments(out)[0]]
    assert kinds == [("JFIF", 0xE0), ("XMP", 0xE1), ("MPF", 0xE2), (None, 0xC0)] and C.xmp_text(out) == "new" and out.endswith(SCAN)
    with pytest.raises(ValueError):
        C.assemble([(0xE1, b"x" * 65534)], b"")


@pytest.mark.parametrize("order", [">", "<"])
def test_mpf(order):
    payload = mpf([(1, 10, 0, 0, 0), (2, 20, 30, 1, 0)], order)
    assert C.mpf_entries(payload) == [(1, 10, 0, 0, 0), (2, 20, 30, 1, 0)]
    new = C.mpf_update(payload, [11, 22], [0, 1044], 1000)
    assert C.mpf_entries(new) == [(1, 11, 0, 0, 0), (2, 22, 40, 1, 0)]
    assert C.mpf_update(payload, [11], [0]) is None and C.mpf_update(payload, [0, 1], [0, 1]) is None and C.mpf_entries(payload[:-1]) is None and C.mpf_entries(b"MPF\0XX" + payload[6:]) is None


def test_mpf_plan():
    other = b"\xff\xd8" + SCAN
    for move, sound in ((0, True), (1, False)):
        make = lambda offset, size: b"\xff\xd8" + seg(0xE2, mpf([(0, size, 0, 0, 0), (0, len(other), offset, 0, 0)])) + SCAN
        size = len(make(0, 1))
        data = make(size - (2 + 4 + 4) + move, size) + other
        assert (C.mpf_plan(data) is not None) is sound
    assert C.mpf_plan(b"\xff\xd8" + SCAN) is None


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(w=3, h=2, depth=8, colour=2, tail=b"", methods=b"\0\0\0", extra=b""):
    return C.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">iiBB", w, h, depth, colour) + methods) + extra + chunk(b"IDAT", b"x") + chunk(b"IEND", b"") + tail


@pytest.mark.parametrize(
    ("data", "reason"),
    [
        (png(), None),
        (png(depth=16), None),
        (png(depth=4), "PNG_LOW_DEPTH"),
        (png(colour=5), "PNG_COLOUR"),
        (png(depth=16, colour=3), "PNG_DEPTH_COLOUR"),
        (png(w=0), "PNG_DIMENSIONS"),
        (png(h=65536), "PNG_DIMENSIONS"),
        (png(methods=b"\0\0\1"), "PNG_INTERLACED"),
        (png(tail=b"x"), "PNG_TRAILING"),
        (png(extra=chunk(b"fdAT", b"")), "PNG_APNG"),
        (png(extra=chunk(b"ABCD", b"")), "PNG_UNKNOWN_CHUNK"),
        (png(extra=chunk(b"abCd", b"")), None),
        (png(extra=chunk(b"abcd", b"")), "PNG_CHUNK_TYPE"),
        (png()[:-1], "PNG_INCOMPLETE"),
        (b"nothing at all", "PNG_SIGNATURE"),
        (C.PNG_SIGNATURE + chunk(b"IDAT", b"x"), "PNG_NO_HEADER"),
        (png()[:29] + b"\0\0\0\0" + png()[33:], "PNG_HEADER_CRC"),
    ],
)
def test_png(data, reason):
    assert C.png_probe(data) == reason


def box(kind, body=b""):
    return struct.pack(">I", 8 + len(body)) + kind + body


def movie(times=(1, 2), offsets=(1000, 2000), extra=b"", first=True):
    stco = box(b"stco", struct.pack(">II", 0, len(offsets)) + struct.pack(f">{len(offsets)}I", *offsets))
    moov = box(b"moov", box(b"mvhd", struct.pack(">III", 0, *times) + b"\0" * 12) + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stco)))) + extra)
    parts = [moov, box(b"mdat", b"data")]
    return box(b"ftyp", b"isom\0\0\0\1") + b"".join(parts if first else parts[::-1])


@pytest.mark.parametrize("first", [True, False])
def test_mp4_inject(first):
    target, source = movie(first=first), movie((1111, 2222), extra=box(b"udta", b"hello") + box(b"udta", b"second"))
    out = C.inject_metadata(target, source)
    assert C.mvhd_times(out) == (1111, 2222) and [(t, s) for t, _, s in C.meta_boxes(out)] == [("udta", 13)]
    at = out.index(b"stco") + 12
    assert struct.unpack_from(">II", out, at) == ((1013, 2013) if first else (1000, 2000)) and C.is_plain_mp4(out)
    assert C.inject_metadata(box(b"ftyp"), source) is None


def test_mp4_boxes():
    wide = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 20) + b"data"
    data = movie() + wide + struct.pack(">I", 0) + b"free" + b"to the end"
    assert [t for t, _, _ in C.boxes(data)] == ["ftyp", "moov", "mdat", "mdat", "free"] and C.is_plain_mp4(data)
    assert not C.is_plain_mp4(data + b"x") or data.endswith(b"end")
    assert C.split_motion(movie() + b"vendor", len(movie())) == (movie(), b"vendor") and C.split_motion(movie(), len(movie())) is None
    assert C.find_mp4_start(b"jpeg" + movie()) == 4 and C.find_mp4_start(movie()) is None and C.find_mp4_start(b"x" * 9 + box(b"ftyp", b"none....")) is None


def test_trailing_marker():
    data = C.append_packet(movie(), "<packet/>")
    assert C.marker_packet(data) == "<packet/>" and C.remove_trailing(data) == movie() and C.top_level_packet(data) == "<packet/>"
    assert C.trailing_box(data + b"x") is None and C.marker_packet(movie()) is None and C.remove_trailing(movie()) == movie()


def test_codec_boxes():
    hvcc = b"hvcC\1" + bytes([0x22]) + b"\0" * 15 + bytes([0xFA])
    assert C.hevc_config(b"...." + hvcc) == (2, 10) and C.hevc_config(b"hvcC") == (-1, -1)
    assert C.colour_info(b"colrnclx" + struct.pack(">HHH", 9, 16, 9)) == (9, 16, 9) and C.colour_info(b"colrprof" + b"\0" * 8) == (-1, -1, -1)


PACKET = '<x:xmpmeta><rdf:RDF><rdf:Description rdf:about="a>b" OpCamera:VideoLength="5116097"><Container:Directory><Container:Item Item:Semantic="Primary" Item:Mime="image/jpeg" Item:Length="0"/><Container:Item Item:Semantic="GainMap" Item:Length="430057"/><Container:Item Item:Mime="video/mp4" Item:Semantic="MotionPhoto" Item:Length="8331026"/></Container:Directory></rdf:Description></rdf:RDF></x:xmpmeta>'


def test_xmp(spark):
    get = lambda c, text=PACKET: spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first().x
    items = get(X.container_items)
    assert [(i.semantic, i.mime, i.length, i.padding) for i in items] == [("Primary", "image/jpeg", 0, 0), ("GainMap", "", 430057, 0), ("MotionPhoto", "video/mp4", 8331026, 0)]
    assert get(X.video_length) == 5116097 and get(X.video_length, "none") == 0
    rewritten = get(lambda t: X.rewrite_item_length(t, "GainMap", F.lit(7)))
    assert rewritten == PACKET.replace("430057", "7") and get(lambda t: X.rewrite_item_length(t, "Nothing", F.lit(7))) == PACKET
    found = get(lambda t: X.detect_motion(t, F.lit(10_000_000).cast("long")))
    assert (found.motion_offset, found.gain_length, found.video_length) == (10_000_000 - 8331026, 430057, 5116097)
    assert get(lambda t: X.detect_motion(t, F.lit(8331026).cast("long"))) is None
    assert get(lambda t: X.primary_end(X.container_items(t), F.lit(10_000_000).cast("long"))) == 10_000_000 - 8331026 - 430057
    marker = F.struct(F.lit("id").alias("id"), F.lit("1.0").alias("version"), F.lit(9).cast("long").alias("time_ms"))
    for text in (PACKET, None, "  ", "<no description/>", '<rdf:Description rdf:about="x"/>'):
        out = get(lambda t: X.inject_marker(t, marker), text)
        assert tuple(get(X.read_marker, out)) == ("id", "1.0", 9)
        assert out == get(lambda t: X.inject_marker(t, marker), out)
    assert get(X.strip_marker, get(lambda t: X.inject_marker(t, marker))) == PACKET
    assert get(X.read_marker, get(X.remove_marker, get(lambda t: X.inject_marker(t, marker), None))) is None
    foreign = PACKET.replace("</rdf:RDF>", '<rdf:Description rdf:about="" xmlns:shoebox="u"><shoebox:itemId>e</shoebox:itemId> <shoebox:writtenMs>7</shoebox:writtenMs></rdf:Description></rdf:RDF>')
    assert tuple(get(X.read_marker, foreign)) == ("e", "", 7) and get(X.remove_marker, foreign) == PACKET and get(X.remove_marker) == PACKET
    assert get(X.read_marker) is None and get(lambda t: X.verify_items(X.container_items(t))) is None and get(lambda t: X.verify_items(X.container_items(t)), "x") == "NO_ITEMS"
