"""Parsers of JPEG, MPF, PNG and MP4 bytes, and their columns.

The parsers are plain functions over ``bytes``; the columns run them on Arrow batches.
A malformed container is a null or a reason code, never an error.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JPEG markers and payload prefixes.
SOI, EOI, SOS, APP0, APP1, APP2, APP15, COM = 0xD8, 0xD9, 0xDA, 0xE0, 0xE1, 0xE2, 0xEF, 0xFE
EXIF, XMP, MPF, JFIF, ICC = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"MPF\0", b"JFIF\0", b"ICC_PROFILE\0"
# PNG signature, chunks, limits.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_CRITICAL = ("IHDR", "PLTE", "IDAT", "IEND")
PNG_KNOWN = (*PNG_CRITICAL, "eXIf", "iTXt", "tEXt", "zTXt", "iCCP", "sRGB", "gAMA", "cHRM", "pHYs", "tIME", "bKGD", "tRNS", "sBIT", "hIST", "sPLT", "cICP", "mDCv", "cLLi")
PNG_ANIMATED = ("acTL", "fcTL", "fdAT")
PNG_MOST_BYTES = 32 << 20
# MP4 brands of embedded videos, boxes that containers nest in, boxes a product writes itself, UUID of XMP boxes.
BRANDS = (b"isom", b"mp42", b"mp41", b"qt  ", b"avc1", b"iso2", b"iso5", b"iso6", b"M4V ")
NESTING = ("moov", "trak", "mdia", "minf", "stbl", "edts", "udta", "mvex", "moof", "traf")
PRODUCT_BOXES = ("mvhd", "trak", "mvex", "iods", "drm", "pssh")
XMP_UUID = bytes.fromhex("BE7ACFCB97A942E89C71999491E3AFAC")
WINDOW, TAIL = 2 << 20, 512 << 10


# JPEG.
def is_jpeg(content: Column) -> Column:
    """B1, in the JVM."""
    return (F.octet_length(content) > 4) & (F.hex(F.substring(content, 1, 2)) == f"FF{SOI:02X}")


def header_segments(data: bytes) -> tuple[list[tuple[int, int, bytes]], int]:
    """B2: ((position, marker, payload) up to the image data, where the rest begins)."""
    out, at = [], 2
    while at + 3 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4])
        if marker in (SOS, EOI) or size < 2 or at + 2 + size > len(data):
            break
        out.append((at, marker, data[at + 4 : at + 2 + size]))
        at += 2 + size
    return out, at


def image_end(data: bytes, start: int = 0, limit: int | None = None) -> int | None:
    """Behind the image's own EOI; entropy-coded scans are stepped over."""
    limit = len(data) if limit is None else limit
    if start < 0 or limit > len(data) or limit - start < 4 or data[start : start + 2] != b"\xff\xd8":
        return None
    at = start + 2
    while at < limit:
        if data[at] != 0xFF:
            return None
        while at < limit and data[at] == 0xFF:
            at += 1
        if at >= limit:
            return None
        marker, at = data[at], at + 1
        if marker == EOI:
            return at
        if marker in (0, SOI):
            return None
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2]) if limit - at >= 2 else 0
        if size < 2 or size > limit - at:
            return None
        at += size
        if marker == SOS:
            # The next marker that is neither stuffing nor a restart.
            while True:
                at = data.find(b"\xff", at, limit)
                if at < 0 or at + 1 >= limit:
                    return None
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    at += 2
                elif data[at + 1] == 0xFF:
                    at += 1
                else:
                    break
    return None


def segment_kind(marker: int, payload: bytes) -> str | None:
    """B4."""
    for name, own, prefix in (("EXIF", APP1, EXIF), ("XMP", APP1, XMP), ("MPF", APP2, MPF), ("JFIF", APP0, JFIF), ("ICC", APP2, ICC)):
        if marker == own and payload.startswith(prefix):
            return name
    return None


def first_segment(data: bytes, kind: str) -> tuple[int, bytes] | None:
    """(position of the payload, payload)."""
    return next(((at + 4, p) for at, m, p in header_segments(data)[0] if segment_kind(m, p) == kind), None)


def xmp_text(data: bytes) -> str | None:
    found = first_segment(data, "XMP")
    return found and found[1][len(XMP) :].decode("utf-8", "replace")


def assemble(segments: list[tuple[int, bytes]], tail: bytes) -> bytes:
    """B6."""
    if any(len(p) + 2 > 0xFFFF for _, p in segments):
        raise ValueError("a segment is too long")
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(p) + 2) + p for m, p in segments) + tail


def _is_metadata(marker: int) -> bool:
    return APP0 <= marker <= APP15 or marker == COM


def rebuild(encoded: bytes, original: bytes, xmp: str | None = None, mpf: bytes | None = None) -> bytes:
    """The encoded image in the original's metadata, with XMP and MPF replaced or added."""
    kept = []
    for _, marker, payload in header_segments(original)[0]:
        if _is_metadata(marker):
            kind = segment_kind(marker, payload)
            if kind == "XMP" and xmp is not None:
                payload = XMP + xmp.encode()
            elif kind == "MPF" and mpf is not None:
                payload = mpf
            kept.append((marker, payload))
    have = {segment_kind(*s) for s in kept}
    if xmp is not None and "XMP" not in have:
        kept.append((APP1, XMP + xmp.encode()))
    if mpf is not None and "MPF" not in have:
        kept.append((APP2, mpf))
    own, tail = header_segments(encoded)
    return assemble(kept + [(m, p) for _, m, p in own if not _is_metadata(m)], encoded[tail:])


def _mpf_table(payload: bytes) -> tuple[str, int, int] | None:
    """(byte order, images, position of the entries)."""
    order = {b"II": "<", b"MM": ">"}.get(payload[4:6]) if payload.startswith(MPF) and len(payload) >= 16 else None
    if order is None or struct.unpack_from(order + "H", payload, 6)[0] != 42:
        return None
    (ifd,) = struct.unpack_from(order + "I", payload, 8)
    if ifd < 8 or ifd > len(payload) - 6:
        return None
    (count,) = struct.unpack_from(order + "H", payload, 4 + ifd)
    if 4 + ifd + 2 + 12 * count + 4 > len(payload):
        return None
    images = entries = size = None
    for i in range(count):
        tag, kind, n, value = struct.unpack_from(order + "HHII", payload, 4 + ifd + 2 + 12 * i)
        if tag == 0xB001:
            if images is not None or kind != 4 or n != 1 or not 0 < value < 1 << 31:
                return None
            images = value
        elif tag == 0xB002:
            if entries is not None or kind != 7 or value < 8 or value > len(payload) - 4:
                return None
            entries, size = 4 + value, n
    if images is None or entries is None or 16 * images != size or entries + size > len(payload):
        return None
    return order, images, entries


def mpf_entries(payload: bytes) -> list[tuple[int, int, int, int, int]] | None:
    """(attributes, size, offset, dependent 1, dependent 2) of each image."""
    table = _mpf_table(payload)
    return table and [struct.unpack_from(table[0] + "IIIHH", payload, table[2] + 16 * i) for i in range(table[1])]


def mpf_update(payload: bytes, sizes: list[int], offsets: list[int], payload_at: int = 0) -> bytes | None:
    """New sizes and file offsets; the entries hold offsets from behind the prefix."""
    table = _mpf_table(payload)
    if table is None or not len(sizes) == len(offsets) == table[1]:
        return None
    out, base = bytearray(payload), payload_at + len(MPF) if payload_at > 0 else 0
    for i, (size, offset) in enumerate(zip(sizes, offsets, strict=True)):
        relative = 0 if i == 0 and offset == 0 else offset - base
        if not (1 <= size < 1 << 32 and 0 <= relative < 1 << 32):
            return None
        struct.pack_into(table[0] + "II", out, table[2] + 16 * i + 4, size, relative)
    return bytes(out)


def mpf_plan(data: bytes) -> tuple[int, list[tuple[int, int]]] | None:
    """(end of the primary image, (start, size) of the others) of a sound multi-picture file."""
    kinds = [segment_kind(m, p) for _, m, p in header_segments(data)[0]]
    found = first_segment(data, "MPF")
    if kinds.count("MPF") != 1 or kinds.count("XMP") > 1 or found is None:
        return None
    entries = mpf_entries(found[1])
    end = image_end(data)
    if entries is None or len(entries) < 2 or entries[0][2] != 0 or end is None or entries[0][1] > len(data):
        return None
    if any(a >> 24 & 7 or s <= 0 or max(d, e) > len(entries) for a, s, _, d, e in entries):
        return None
    others = [(found[0] + 4 + offset, size) for _, size, offset, _, _ in entries[1:]]
    if any(s < end or s >= len(data) or n > len(data) - s or image_end(data, s, s + n) is None for s, n in others):
        return None
    before = end
    for s, n in sorted(others):
        if s < before:
            return None
        before = s + n
    return end, others


# PNG.
def chunk_crc(kind: Column, body: Column) -> Column:
    """B32, in the JVM: checksum of a chunk's type and body."""
    return F.crc32(F.concat(kind, body))


def depth_reason(depth: int, colour: int) -> str | None:
    """B27."""
    if depth not in (8, 16):
        return "PNG_LOW_DEPTH"
    if colour not in (0, 2, 3, 4, 6):
        return "PNG_COLOUR"
    return "PNG_DEPTH_COLOUR" if depth == 16 and colour == 3 else None


def png_probe(data: bytes) -> str | None:
    """The first check that fails, or null; image data is stepped over."""
    if len(data) > PNG_MOST_BYTES:
        return "PNG_TOO_LARGE"
    if data[:8] != PNG_SIGNATURE:
        return "PNG_SIGNATURE"
    at, header, pixels = 8, False, False
    while at + 12 <= len(data):
        size, name = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8].decode("latin-1")
        if size >= 1 << 31 or size + 12 > len(data) - at:
            return "PNG_CHUNK_BOUNDS"
        if not (name.isascii() and name.isalpha() and name[2].isupper()):
            return "PNG_CHUNK_TYPE"
        if name in PNG_ANIMATED:
            return "PNG_APNG"
        if name not in PNG_KNOWN and not (name[0].islower() and name[3].islower()):
            return "PNG_UNKNOWN_CHUNK"
        if not header:
            if name != "IHDR" or size != 13:
                return "PNG_NO_HEADER"
            body = data[at + 8 : at + 21]
            if zlib.crc32(data[at + 4 : at + 21]) != int.from_bytes(data[at + 21 : at + 25]):
                return "PNG_HEADER_CRC"
            width, height, depth, colour, *methods = struct.unpack(">iiBBBBB", body)
            if not (1 <= width <= 65535 and 1 <= height <= 65535):
                return "PNG_DIMENSIONS"
            if reason := depth_reason(depth, colour):
                return reason
            if any(methods):
                return "PNG_INTERLACED"
            header = True
        at += 12 + size
        pixels |= name == "IDAT"
        if name == "IEND":
            return None if size == 0 and at == len(data) and pixels else "PNG_TRAILING"
    return "PNG_INCOMPLETE"


# MP4.
def boxes(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """(type, offset, size) of one level; ends quietly at the first unsound box."""
    end, out, at = len(data) if end is None else end, [], start
    while at + 8 <= end:
        size, raw = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        if not all(32 <= b <= 126 for b in raw):
            break
        if size == 1:
            if at + 16 > len(data):
                break
            size = int.from_bytes(data[at + 8 : at + 16])
        elif size == 0:
            size = end - at
        if size < 8 or at + size > end:
            break
        out.append((raw.decode(), at, size))
        at += size
    return out


def is_plain_mp4(data: bytes) -> bool:
    """Boxes cover all bytes, with ftyp, moov and mdat among them."""
    found = boxes(data)
    return len(data) >= 12 and bool(found) and found[-1][1] + found[-1][2] == len(data) and {"ftyp", "moov", "mdat"} <= {t for t, _, _ in found}


def split_motion(data: bytes, video: int) -> tuple[bytes, bytes] | None:
    """(video, vendor tail)."""
    return (data[:video], data[video:]) if 0 < video < len(data) and is_plain_mp4(data[:video]) else None


def find_mp4_start(data: bytes) -> int | None:
    """The first embedded ftyp box with a plausible size and brand, not at the very start."""
    at = data.find(b"ftyp", 4)
    while at >= 0:
        if at + 8 <= len(data) and at > 4 and 8 <= int.from_bytes(data[at - 4 : at], signed=True) <= len(data) and data[at + 4 : at + 8] in BRANDS:
            return at - 4
        at = data.find(b"ftyp", at + 1)
    return None


def _moov(data: bytes) -> tuple[str, int, int] | None:
    return next((b for b in boxes(data) if b[0] == "moov"), None)


def meta_boxes(data: bytes) -> list[tuple[str, int, int]]:
    """Children of moov that a product doesn't write itself."""
    moov = _moov(data)
    return [b for b in boxes(data, moov[1] + 8, moov[1] + moov[2]) if b[0] not in PRODUCT_BOXES] if moov else []


def mvhd_times(data: bytes) -> tuple[int, int] | None:
    """(creation, modification)."""
    moov = _moov(data)
    mvhd = moov and next((b for b in boxes(data, moov[1] + 8, moov[1] + moov[2]) if b[0] == "mvhd"), None)
    if not mvhd:
        return None
    head = data[mvhd[1] : mvhd[1] + min(mvhd[2], 32)]
    form = ">QQ" if len(head) > 8 and head[8] == 1 else ">II"
    return struct.unpack_from(form, head, 12) if len(head) >= 12 + struct.calcsize(form) else None


def _shift(buffer: bytearray, start: int, end: int, delta: int) -> None:
    for kind, at, size in boxes(bytes(buffer), start, end):
        if kind in ("stco", "co64"):
            width = 4 if kind == "stco" else 8
            (count,) = struct.unpack_from(">I", buffer, at + 12)
            for i in range(min(count, (size - 16) // width)):
                p = at + 16 + i * width
                buffer[p : p + width] = ((int.from_bytes(buffer[p : p + width]) + delta) % (1 << 8 * width)).to_bytes(width)
        elif kind in NESTING:
            _shift(buffer, at + 8, at + size, delta)


def inject_metadata(target: bytes, source: bytes) -> bytes | None:
    """The source's metadata boxes and times in the target; chunk offsets follow where moov comes first."""
    extra, times = meta_boxes(source), mvhd_times(source)
    if not extra and times is None:
        return target
    moov = _moov(target)
    if moov is None:
        return None
    new: dict[str, bytes] = {}
    for kind, at, size in extra:
        new.setdefault(kind, source[at : at + size])
    parts = [new.pop(kind, target[at : at + size]) for kind, at, size in boxes(target, moov[1] + 8, moov[1] + moov[2])]
    body = b"".join(parts + list(new.values()))
    out = bytearray(struct.pack(">I", len(body) + 8) + b"moov" + body)
    if times is not None:
        mvhd = next((b for b in boxes(bytes(out), 8) if b[0] == "mvhd"), None)
        if mvhd is not None:
            form = ">QQ" if out[mvhd[1] + 8] == 1 else ">II"
            if form == ">QQ" or max(times) < 1 << 32:
                struct.pack_into(form, out, mvhd[1] + 12, *times)
    delta = len(out) - moov[2]
    media = next((b for b in boxes(target) if b[0] == "mdat"), None)
    if delta and media is not None and moov[1] < media[1]:
        _shift(out, 8, len(out), delta)
    return target[: moov[1]] + bytes(out) + target[moov[1] + moov[2] :]


def trailing_box(data: bytes, uuid: bytes = XMP_UUID) -> tuple[int, int] | None:
    """(start, end) of the marker box that ends the file."""
    start = max(0, len(data) - TAIL)
    at = data.find(uuid, start)
    if len(data) < 32 or at - start < 8:
        return None
    size = int.from_bytes(data[at - 8 : at - 4], signed=True)
    return (at - 8, len(data)) if data[at - 4 : at] == b"uuid" and size > 20 and at - 8 + size == len(data) else None


def marker_packet(data: bytes) -> str | None:
    found = trailing_box(data)
    return found and data[found[0] + 24 : found[1]].decode("utf-8", "replace") if found and found[1] - found[0] > 24 else None


def append_packet(data: bytes, packet: str) -> bytes:
    """B42."""
    raw = packet.encode()
    return data + struct.pack(">I", 24 + len(raw)) + b"uuid" + XMP_UUID + raw


def remove_trailing(data: bytes) -> bytes:
    found = trailing_box(data)
    return data[: found[0]] if found else data


def top_level_packet(data: bytes, uuid: bytes = XMP_UUID) -> str | None:
    """Body of the first top-level box of this UUID, up to 64 KiB."""
    for kind, at, size in boxes(data)[:8192]:
        header = 16 if int.from_bytes(data[at : at + 4]) == 1 else 8
        if kind == "uuid" and header + 16 <= size <= header + 65536 and data[at + header : at + header + 16] == uuid:
            return data[at + header + 16 : at + size].decode("utf-8", "replace")
    return None


def _windows(data: bytes) -> Iterator[bytes]:
    yield data[:WINDOW]
    yield data[max(0, len(data) - WINDOW) :]


def hevc_config(data: bytes) -> tuple[int, int]:
    """(profile, luma depth), or (-1, -1)."""
    for w in _windows(data):
        at = w.find(b"hvcC")
        if at >= 0 and at + 22 <= len(w):
            return w[at + 5] & 0x1F, (w[at + 21] & 7) + 8
    return -1, -1


def colour_info(data: bytes) -> tuple[int, int, int]:
    """(primaries, transfer, matrix), or three times -1; only a window's first colour box counts."""
    for w in _windows(data):
        at = w.find(b"colr")
        if at >= 0 and at + 14 <= len(w) and w[at + 4 : at + 8] in (b"nclx", b"nclc"):
            return struct.unpack_from(">HHH", w, at + 8)
    return -1, -1, -1


# Columns.
def column(f: Callable[[bytes], object], kind: str | T.DataType) -> Callable[[Column], Column]:
    """``f`` over a binary column, in Arrow batches, whose bytes ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds (64 MB
    unless set otherwise); null stays null."""
    struct_type = isinstance(kind, str) and kind.startswith("struct")

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(bytes(x)))

    if struct_type:
        names = [x.split(":")[0].split()[0] for x in kind.removeprefix("struct<").removesuffix(">").split(",")]

        def frame(s: pd.Series) -> pd.DataFrame:
            rows = [None if x is None else f(bytes(x)) for x in s]
            return pd.DataFrame([dict.fromkeys(names) if r is None else dict(zip(names, r, strict=True)) for r in rows], columns=names, dtype=object)

        frame.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(frame, kind)
    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)


SEGMENTS = "array<struct<pos:int,marker:int,kind:string,size:int>>"
BOXES = "array<struct<type:string,offset:long,size:long>>"
ENTRIES = "array<struct<attributes:long,size:long,offset:long,dep1:int,dep2:int>>"


def segments_column(c: Column) -> Column:
    return column(lambda d: [{"pos": at, "marker": m, "kind": segment_kind(m, p), "size": len(p)} for at, m, p in header_segments(d)[0]], SEGMENTS)(c)


def boxes_column(c: Column, children_of_moov: bool = False) -> Column:
    parse = meta_boxes if children_of_moov else boxes
    return column(lambda d: [{"type": t, "offset": o, "size": n} for t, o, n in parse(d)], BOXES)(c)


def entries_column(c: Column) -> Column:
    def parse(d: bytes):
        found = first_segment(d, "MPF")
        entries = found and mpf_entries(found[1])
        return entries and [dict(zip(("attributes", "size", "offset", "dep1", "dep2"), e, strict=True)) for e in entries]

    return column(parse, ENTRIES)(c)


def mpf_rebuild(original: bytes, encoded: bytes, xmp: str) -> bytes | None:
    """The encoded primary image in the original's metadata, with the other images behind it.

    Lengths in the XMP and offsets in the MPF depend on the header's size, which their digits may
    change; it settles within a few rounds. The result must read back as planned.
    """
    plan = mpf_plan(original)
    found = first_segment(original, "MPF")
    if plan is None or found is None:
        return None
    end, others = plan
    keeps_length = re.search(r'<Container:Item\b[^>]*Item:Semantic="Primary"[^>]*>', xmp)
    keeps_length = keeps_length and re.search(r'Item:Length="[1-9]\d*"', keeps_length[0])
    primary = rebuild(encoded, original, xmp)
    for _ in range(6):
        text = xmp
        if keeps_length:
            text = re.sub(r'<Container:Item\b[^>]*Item:Semantic="Primary"[^>]*>', lambda m: re.sub(r'Item:Length="\d*"', f'Item:Length="{len(primary)}"', m[0]), xmp, count=1)
        at = first_segment(primary, "MPF")
        starts = [0] + [s + len(primary) - end for s, _ in others]
        patched = at and mpf_update(found[1], [len(primary)] + [n for _, n in others], starts, at[0])
        if not patched:
            return None
        after = rebuild(encoded, original, text, patched)
        if len(after) == len(primary):
            out = after + original[end:]
            again = mpf_plan(out)
            return out if again == (len(after), [(s, n) for s, (_, n) in zip(starts[1:], others, strict=True)]) else None
        primary = after
    return None
