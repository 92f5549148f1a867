"""Whole PNG files: structure with all checksums, pixel rows, XMP texts, metadata archives.

Where the probe in ``containers`` looks at headers, these read everything. Failures are
``Refused`` with a reason code.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from .containers import APP15, PNG_ANIMATED, PNG_KNOWN, PNG_MOST_BYTES, PNG_SIGNATURE, assemble, column, depth_reason, header_segments

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
XMP_KEYWORD = b"XML:com.adobe.xmp"
MOST_TEXT = 65533
#: Prefix of the archive's segments; a library written by another program names its own.
ARCHIVE = b"ShoeboxPNG\0"


class Refused(ValueError):
    """Reason code of a file that isn't processed."""


@dataclass
class Png:
    width: int
    height: int
    depth: int
    colour: int
    chunks: list[tuple[str, bytes, bytes]]  # name, body, whole chunk

    @property
    def pixel(self) -> int:
        """Bytes of a pixel."""
        return CHANNELS[self.colour] * self.depth // 8

    @property
    def stride(self) -> int:
        return self.width * self.pixel

    def bodies(self, name: str) -> list[bytes]:
        return [b for n, b, _ in self.chunks if n == name]

    def metadata_bytes(self) -> int:
        """Bytes of all chunks but the image data."""
        return sum(len(w) for n, _, w in self.chunks if n != "IDAT")


def parse(data: bytes) -> Png:
    """B28."""
    if len(data) > PNG_MOST_BYTES or len(data) < 33 or not data.startswith(PNG_SIGNATURE):
        raise Refused("PNG_SIGNATURE")
    chunks, at = [], 8
    while at + 12 <= len(data) and not (chunks and chunks[-1][0] == "IEND"):
        size, name = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8].decode("latin-1")
        if size >= 1 << 31 or at + 12 + size > len(data):
            raise Refused("PNG_CHUNK_BOUNDS")
        if not (name.isascii() and name.isalpha() and name[2].isupper()):
            raise Refused("PNG_CHUNK_TYPE")
        whole = data[at : at + 12 + size]
        if zlib.crc32(whole[4:-4]) != int.from_bytes(whole[-4:]):
            raise Refused("PNG_CHUNK_CRC")
        if name in PNG_ANIMATED:
            raise Refused("PNG_APNG")
        if name not in PNG_KNOWN and not (name[0].islower() and name[3].islower()):
            raise Refused("PNG_UNKNOWN_CHUNK")
        chunks.append((name, whole[8:-4], whole))
        at += len(whole)
    names = [n for n, _, _ in chunks]
    pixels = [i for i, n in enumerate(names) if n == "IDAT"]
    if pixels and pixels[-1] - pixels[0] + 1 != len(pixels):
        raise Refused("PNG_DATA_ORDER")
    if at != len(data) or not pixels or names[0] != "IHDR" or len(chunks[0][1]) != 13 or names.count("IHDR") != 1 or names[-1] != "IEND" or chunks[-1][1]:
        raise Refused("PNG_INCOMPLETE")
    width, height, depth, colour, *methods = struct.unpack(">iiBBBBB", chunks[0][1])
    if not (1 <= width <= 65535 and 1 <= height <= 65535):
        raise Refused("PNG_DIMENSIONS")
    if reason := depth_reason(depth, colour):
        raise Refused(reason)
    if any(methods):
        raise Refused("PNG_INTERLACED")
    out = Png(width, height, depth, colour, chunks)
    palette, early = out.bodies("PLTE"), names[: pixels[0]]
    if len(palette) > 1 or any(not 3 <= len(p) <= 768 or len(p) % 3 for p in palette) or len(palette) != early.count("PLTE"):
        raise Refused("PNG_PALETTE")
    if (colour == 3) > len(palette) or (colour in (0, 4) and palette):
        raise Refused("PNG_PALETTE")
    clear = out.bodies("tRNS")
    sizes = {0: range(2, 3), 2: range(6, 7), 3: range(1, len(palette[0]) // 3 + 1) if palette else range(0)}
    if len(clear) > 1 or len(clear) != early.count("tRNS") or any(len(c) not in sizes.get(colour, ()) for c in clear):
        raise Refused("PNG_TRANSPARENCY")
    return out


def _paeth(row: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    out = row.astype(np.int64)
    for x in range(0, len(row), pixel):
        left = out[x - pixel : x] if x else np.zeros(pixel, np.int64)
        corner = above[x - pixel : x].astype(np.int64) if x else np.zeros(pixel, np.int64)
        up = above[x : x + pixel].astype(np.int64)
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        out[x : x + pixel] = (out[x : x + pixel] + np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))) & 255
    return out.astype(np.uint8)


def rows(png: Png) -> np.ndarray:
    """The pixel bytes, filters undone, [height, stride]."""
    try:
        inflate = zlib.decompressobj()
        plain = inflate.decompress(b"".join(png.bodies("IDAT")))
    except zlib.error as e:
        raise Refused("PNG_PIXELS") from e
    if not inflate.eof or inflate.unused_data or len(plain) != png.height * (png.stride + 1):
        raise Refused("PNG_PIXELS")
    raw = np.frombuffer(plain, np.uint8).reshape(png.height, png.stride + 1)
    out, above = np.zeros((png.height, png.stride), np.uint8), np.zeros(png.stride, np.uint8)
    for y, line in enumerate(raw):
        kind, row = int(line[0]), line[1:]
        if kind > 4:
            raise Refused("PNG_FILTER")
        if kind == 1:
            row = np.cumsum(row.reshape(-1, png.pixel), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind == 3:
            done = row.astype(np.int64)
            for x in range(0, png.stride, png.pixel):
                left = done[x - png.pixel : x] if x else 0
                done[x : x + png.pixel] = (done[x : x + png.pixel] + (left + above[x : x + png.pixel].astype(np.int64)) // 2) & 255
            row = done.astype(np.uint8)
        elif kind == 4:
            row = _paeth(row, above, png.pixel)
        out[y] = above = row
    if png.colour == 3 and out.max() >= len(png.bodies("PLTE")[0]) // 3:
        raise Refused("PNG_PALETTE_INDEX")
    return out


def reason(data: bytes) -> str | None:
    """Null for a file whose structure and pixels are sound."""
    try:
        rows(parse(data))
    except Refused as e:
        return str(e)
    return None


def xmp_text(name: str, body: bytes) -> str | None:
    """The XMP packet of a text chunk, null for other chunks."""
    keyword, zero, rest = body.partition(b"\0")
    if name not in ("iTXt", "tEXt", "zTXt") or not zero or keyword != XMP_KEYWORD:
        return None
    packed = name == "zTXt"
    if name == "iTXt":
        if len(rest) < 2 or rest[0] > 1 or rest[1]:
            raise Refused("PNG_XMP_METHOD")
        packed, parts = rest[0] == 1, rest[2:].split(b"\0", 2)
        if len(parts) < 3:
            raise Refused("PNG_XMP_BOUNDS")
        rest = parts[2]
    elif packed:
        if rest[:1] != b"\0":
            raise Refused("PNG_XMP_METHOD")
        rest = rest[1:]
    if packed:
        try:
            rest = zlib.decompressobj().decompress(rest, MOST_TEXT + 1)
        except zlib.error as e:
            raise Refused("PNG_XMP_METHOD") from e
    if len(rest) > MOST_TEXT:
        raise Refused("PNG_XMP_SIZE")
    try:
        return rest.decode()
    except UnicodeDecodeError as e:
        raise Refused("PNG_XMP_ENCODING") from e


def archive_segments(png: Png, prefix: bytes = ARCHIVE) -> list[tuple[int, bytes]]:
    """Everything but the image data, as numbered JPEG segments."""
    whole = PNG_SIGNATURE + b"".join(w for n, _, w in png.chunks if n != "IDAT")
    room = MOST_TEXT - len(prefix) - 8
    parts = [whole[i : i + room] for i in range(0, len(whole), room)]
    return [(APP15, prefix + struct.pack(">II", i, len(parts)) + p) for i, p in enumerate(parts)]


def read_archive(jpeg: bytes, prefix: bytes = ARCHIVE) -> bytes | None:
    """The archive in a JPEG; null where parts are missing or out of order."""
    parts = [p[len(prefix) :] for _, m, p in header_segments(jpeg)[0] if m == APP15 and p.startswith(prefix)]
    heads = [struct.unpack_from(">II", p) for p in parts if len(p) >= 8]
    return b"".join(p[8:] for p in parts) if parts and heads == [(i, len(parts)) for i in range(len(parts))] else None


def packet(data: bytes) -> str | None:
    """B30 of a file: its first XMP packet; null without one, or in a file that isn't sound."""
    try:
        return next((t for n, b, _ in parse(data).chunks if (t := xmp_text(n, b)) is not None), None)
    except Refused:
        return None


def archived(data: bytes) -> tuple[int, int, bool] | None:
    """A18, B31 of a file: (bytes of metadata, bytes of the archive as it reads back, whether all is there)."""
    try:
        png = parse(data)
    except Refused:
        return None
    back = read_archive(assemble(archive_segments(png), b"\xff\xd9"))
    whole = PNG_SIGNATURE + b"".join(w for n, _, w in png.chunks if n != "IDAT")
    return png.metadata_bytes(), len(back or b""), back == whole


def _facts(data: bytes) -> tuple:
    try:
        png = parse(data)
        return None, png.width, png.height, int(rows(png).sum(dtype=np.int64))
    except Refused as e:
        return str(e), None, None, None


def facts_column(c: Column) -> Column:
    """Struct (reason, width, height, pixels), pixels being the sum of their bytes."""
    return column(_facts, "struct<reason:string,width:int,height:int,pixels:long>")(c)
