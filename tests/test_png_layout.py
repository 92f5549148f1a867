"""Whole PNG files, byte ranges, new names."""

import struct
import zlib

import numpy as np
import pytest

from shoebox.functions import containers as C
from shoebox.functions import png as P
from shoebox.operators import layout

from .test_containers import chunk


def make(colour=2, depth=8, w=5, h=5, filters=(0, 1, 2, 3, 4), before=b"", after=b"", seed=1, most=256):
    pixel = P.CHANNELS[colour] * depth // 8
    want = np.random.default_rng(seed).integers(0, most, (h, w * pixel)).astype(np.uint8)
    lines, above = [], np.zeros(w * pixel, np.int64)
    for y in range(h):
        row, f = want[y].astype(np.int64), filters[y % len(filters)]
        left = np.concatenate([np.zeros(pixel, np.int64), row[:-pixel]])
        corner = np.concatenate([np.zeros(pixel, np.int64), above[:-pixel]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][f]
        lines.append(bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    body = zlib.compress(b"".join(lines))
    head = chunk(b"IHDR", struct.pack(">iiBBBBB", w, h, depth, colour, 0, 0, 0))
    return C.PNG_SIGNATURE + head + before + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + after + chunk(b"IEND", b""), want


@pytest.mark.parametrize(("colour", "depth"), [(0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (6, 8), (6, 16)])
def test_rows(colour, depth):
    data, want = make(colour, depth)
    assert (P.rows(P.parse(data)) == want).all() and P.reason(data) is None and C.png_probe(data) is None


PALETTE = chunk(b"PLTE", b"abc" * 10)


@pytest.mark.parametrize(
    ("data", "reason"),
    [
        (make(3, before=PALETTE, most=10)[0], None),
        (make(3, before=PALETTE, most=250)[0], "PNG_PALETTE_INDEX"),
        (make(3)[0], "PNG_PALETTE"),
        (make(0, before=PALETTE)[0], "PNG_PALETTE"),
        (make(2, after=PALETTE)[0], "PNG_PALETTE"),
        (make(2, before=chunk(b"tRNS", b"x"))[0], "PNG_TRANSPARENCY"),
        (make(2, before=chunk(b"tRNS", b"xxxxxx"))[0], None),
        (make()[0][:-1], "PNG_INCOMPLETE"),
        (make(after=chunk(b"tEXt", b"a") + chunk(b"IDAT", b""))[0], "PNG_DATA_ORDER"),
        (make()[0].replace(b"IEND\xaeB`\x82", b"IEND\xaeB`\x83"), "PNG_CHUNK_CRC"),
        (C.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">iiBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0\0")) + chunk(b"IEND", b""), "PNG_PIXELS"),
        (C.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">iiBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\5\0")) + chunk(b"IEND", b""), "PNG_FILTER"),
        (C.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">iiBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"junk") + chunk(b"IEND", b""), "PNG_PIXELS"),
    ],
)
def test_reasons(data, reason):
    assert P.reason(data) == reason


def test_xmp():
    key = P.XMP_KEYWORD + b"\0"
    assert P.xmp_text("tEXt", key + b"<x/>") == P.xmp_text("zTXt", key + b"\0" + zlib.compress(b"<x/>")) == P.xmp_text("iTXt", key + b"\0\0en\0k\0<x/>") == P.xmp_text("iTXt", key + b"\1\0\0\0" + zlib.compress(b"<x/>")) == "<x/>"
    assert P.xmp_text("tEXt", b"other\0x") is None and P.xmp_text("IDAT", key) is None
    for name, body in (("iTXt", key + b"\2\0"), ("iTXt", key + b"\0\0nozero"), ("zTXt", key + b"\1x"), ("tEXt", key + b"\xff"), ("tEXt", key + b"x" * 65534), ("zTXt", key + b"\0junk")):
        with pytest.raises(P.Refused):
            P.xmp_text(name, body)


def test_archive():
    png = P.parse(make(before=chunk(b"teXt", b"z" * 150_000))[0])
    segments = P.archive_segments(png)
    jpeg = C.assemble(segments, b"\xff\xd9")
    assert len(segments) == 3 and P.read_archive(jpeg).startswith(C.PNG_SIGNATURE) and len(P.read_archive(jpeg)) == 8 + png.metadata_bytes()
    assert P.read_archive(C.assemble(segments[::-1], b"\xff\xd9")) is None and P.read_archive(b"\xff\xd8\xff\xd9") is None


def test_names(spark):
    wanted = spark.createDataFrame([("/d", "a.png", 1), ("/d", "a.PNG", 2), ("/d", "a.b.png", 3), ("/e", "a.png", 4), ("/d", "a.png", 5), ("/d", "é" * 200 + ".png", 6), ("/d", "plain", 7)], "directory string, name string, seq int")
    existing = spark.createDataFrame([("/d", "a.jpg"), ("/d", "a_2.jpg"), ("/d", "a_x.jpg"), ("/d", "plain_1.jpg")], "directory string, name string")
    got = {r.seq: r.destination for r in layout.unique_destinations(wanted, existing).collect()}
    assert got == {1: "a_1.jpg", 2: "a_3.jpg", 3: "a.b.jpg", 4: "a.jpg", 5: "a_4.jpg", 6: "é" * 125 + ".jpg", 7: "plain.jpg"}


def test_names_of_large_groups(spark):
    """Against a search name by name; rows of a group carry no list of the group's numbers."""
    wanted = [("/d", f"{'ab'[i % 2]}.png", (i * 7) % 500) for i in range(500)] + [(None, "a.png", 1), (None, "a.png", 2), ("/d", None, 1000)]
    existing = [("/d", f"a_{n}.jpg") for n in (1, 2, 5, 6, 90, 250, 10**9, 10**10)] + [("/d", "a.jpg"), ("/d", "a_2.jpg"), ("/d", "a_07.jpg"), ("/d", "b_3.jpg"), ("/d", None), (None, "z.jpg")]
    got = layout.unique_destinations(spark.createDataFrame(wanted, "directory string, name string, seq int"), spark.createDataFrame(existing, "directory string, name string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "collect_set(" not in plan
    there, want = set(existing), set()
    for folder, name, seq in sorted(wanted, key=lambda x: x[2]):
        if name:
            found = next(x for n in range(1000) if (folder, x := name[0] + (f"_{n}" if n else "") + ".jpg") not in there)
            there.add((folder, found))
        want.add((folder, name, seq, found if name else None))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(wanted)
