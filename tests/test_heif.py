"""HEIF stills: relations, rules, rebuilding."""

import pytest

from shoebox.functions import containers as C
from shoebox.functions import heif as H
from shoebox.plans.heif_queries import EXIF, FAULTS, PRIMARY, make_heif


@pytest.mark.parametrize("k", range(60))
def test_reasons(k):
    assert H.reason(make_heif(k)) == FAULTS.get(k % 12)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda b: b"", "HEIF_BOXES"),
        (lambda b: b[:40], "HEIF_BOXES"),
        (lambda b: b.replace(b"heic", b"avif", 1), "HEIF_BRAND"),
        (lambda b: b.replace(b"hvc1", b"av01"), "HEIF_CODEC"),
        (lambda b: b.replace(b"nclx", b"none"), "HEIF_COLOUR"),
        (lambda b: b.replace(b"ispe", b"irot"), "HEIF_ISPE"),
        (lambda b: b.replace(b"pixi", b"clap"), "HEIF_PROPERTY"),
        (lambda b: b.replace(b"hdlr", b"grpl"), "HEIF_EXTENSION"),
        (lambda b: b.replace(b"mdat", b"moov"), "HEIF_SEQUENCE"),
        (lambda b: b.replace(b"\0\0\0\1\0\x64\0\xc8", b"\0\0\1\1\0\x64\0\xc8"), None),
        (lambda b: b.replace(b"\0\0\1\1\0\x65\0\xc8", b"\0\0\2\1\0\x65\0\xc8"), "HEIF_GRID"),
        (lambda b: b + b"\0\0\0\x30free", "HEIF_BOXES"),
        (lambda b: b + b"\1\2", None),
    ],
)
def test_changed_files(change, reason):
    assert H.reason(change(make_heif(1))) == reason


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 5, 15, 25])
def test_rebuild(k):
    original, encoded = make_heif(k), make_heif(k, b"better", 3)
    out = H.rebuild(original, encoded, "<packet/>")
    before, after = H.admitted(original), H.admitted(out)
    assert C.top_level_packet(out) == "<packet/>" and after.payload(EXIF) == before.payload(EXIF)
    assert [after.payload(t) for t in after.tiles] == [H.admitted(encoded).payload(t) for t in before.tiles]
    assert (PRIMARY in after.tiles) == (k % 3 == 0) and out[after.tail :] == original[before.tail :]
    assert H.rebuild(out, encoded, "<again/>").count(b"<again/>") == 1


def test_rebuild_refuses():
    for other in (make_heif(2), make_heif(51), make_heif(13), make_heif(6)):
        with pytest.raises(H.Refused):
            H.rebuild(make_heif(1), other, "")
