"""HEIF stills: the relations inside a file, the rules by which one is processed, and its rebuilding.

A file is read into relations that share the item id: items, extents, properties, links between
items and properties, references between items. Rules look at the relations only; each has a
reason code, and the first that a file breaks is its reason. A rebuilt file has the encoded
image's data in place of the original's tiles, everything else as it was, and a packet at its end;
it is read again, and every relation must be the original's but for the tiles.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise

from pyspark.sql import Column

from .containers import XMP_UUID, boxes, column

# Box types, brands, limits and transfer codes of the format and of what is processed.
BRANDS = (b"heic", b"heix", b"mif1")
TOP = ("ftyp", "meta", "mdat", "free", "skip", "uuid", "QTI ")
SEQUENCES = ("moov", "moof", "sidx")
CHILDREN = ("hdlr", "pitm", "iloc", "iinf", "iprp", "iref", "idat", "dinf", "free", "skip")
REFERENCES = ("dimg", "thmb", "cdsc")
PROPERTIES = ("hvcC", "ispe", "colr", "pixi")
COLOURS = (b"prof", b"rICC", b"nclx")
HDR_TRANSFERS = (16, 18)
MOST_BYTES, MOST_PIXELS, MOST_ENTRIES, MOST_TILES = 64 << 20, 64_000_000, 4096, 256


class Refused(ValueError):
    """Reason code of a file that isn't processed."""


def refuse_unless(ok: bool, reason: str) -> None:
    if not ok:
        raise Refused(reason)


class Fields:
    """Big-endian numbers, one after another, within bounds."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def take(self, width: int) -> int:
        refuse_unless(self.at + width <= self.end, "HEIF_BOUNDS")
        self.at += width
        value = int.from_bytes(self.data[self.at - width : self.at])
        refuse_unless(value < 1 << 31, "HEIF_BOUNDS")
        return value

    def version(self, most: int, least: int = 0) -> tuple[int, int]:
        """(version, flags) that begin a full box."""
        found = self.take(1), self.take(3)
        refuse_unless(least <= found[0] <= most, "HEIF_VERSION")
        return found

    def count(self, width: int) -> range:
        n = self.take(width)
        refuse_unless(n <= MOST_ENTRIES, "HEIF_ENTRIES")
        return range(n)

    def done(self) -> None:
        refuse_unless(self.at == self.end, "HEIF_FIELDS")


@dataclass
class Box:
    kind: str
    at: int
    size: int
    head: int = 8

    @property
    def body(self) -> int:
        return self.at + self.head

    @property
    def end(self) -> int:
        return self.at + self.size


@dataclass
class Extents:
    """Where an item's bytes are: ``method`` 0 counts from the file's begin, 1 within the box ``idat``."""

    method: int
    source: int
    ranges: list[tuple[int, int]]


@dataclass
class Heif:
    """The relations of one file."""

    data: bytes
    top: list[Box] = field(default_factory=list)
    children: list[Box] = field(default_factory=list)
    property_boxes: list[Box] = field(default_factory=list)
    properties: list[Box] = field(default_factory=list)
    items: dict[int, str] = field(default_factory=dict)
    extents: dict[int, Extents] = field(default_factory=dict)
    links: dict[int, list[tuple[int, bool]]] = field(default_factory=dict)
    references: list[tuple[str, int, list[int]]] = field(default_factory=list)
    primary: int = 0

    def level(self, start: int, end: int) -> list[Box]:
        found = [Box(k, at, n, 16 if int.from_bytes(self.data[at : at + 4]) == 1 else 8) for k, at, n in boxes(self.data, start, end)]
        refuse_unless(len(found) < 2 * MOST_ENTRIES and all(b.size >= b.head for b in found), "HEIF_BOXES")
        return found

    def whole(self, start: int, end: int) -> list[Box]:
        """Boxes that fill a range to its end."""
        found = self.level(start, end)
        refuse_unless((found[-1].end if found else start) == end, "HEIF_BOXES")
        return found

    def raw(self, b: Box) -> bytes:
        return self.data[b.at : b.end]

    def fields(self, b: Box) -> Fields:
        return Fields(self.data, b.body, b.end)

    def one(self, among: list[Box], kind: str, needed: bool = True) -> Box | None:
        found = [b for b in among if b.kind == kind]
        refuse_unless(len(found) == 1 or (not found and not needed), "HEIF_" + kind.strip().upper())
        return found[0] if found else None

    @cached_property
    def tail(self) -> int:
        return self.top[-1].end

    @cached_property
    def mdat(self) -> Box:
        return self.one(self.top, "mdat")

    @cached_property
    def meta(self) -> Box:
        return self.one(self.top, "meta")

    @cached_property
    def tiles(self) -> list[int]:
        """The items that hold the primary image's data."""
        if self.items[self.primary] != "grid":
            return [self.primary]
        parts = [to for kind, of, to in self.references if kind == "dimg" and of == self.primary]
        refuse_unless(len(parts) == 1, "HEIF_GRID")
        return parts[0]

    @cached_property
    def size(self) -> tuple[int, int]:
        return self.size_of(self.primary)

    def size_of(self, item: int) -> tuple[int, int]:
        f = self.fields(self.one(self.of(item), "ispe"))
        refuse_unless(f.take(4) == 0, "HEIF_VERSION")
        out = f.take(4), f.take(4)
        f.done()
        return out

    def of(self, item: int) -> list[Box]:
        """Properties of an item."""
        return [self.properties[i - 1] for i, _ in self.links.get(item, [])]

    def payload(self, item: int) -> bytes:
        where, base, end = self.extents[item], 0, len(self.data)
        if where.method == 1:
            idat = self.one(self.children, "idat")
            base, end = idat.body, idat.end
        refuse_unless(all(n > 0 and base + at + n <= end for at, n in where.ranges), "HEIF_EXTENT_BOUNDS")
        return b"".join(self.data[base + at : base + at + n] for at, n in where.ranges)


# Readers of the relations.
def _items(m: Heif) -> None:
    b = m.one(m.children, "iinf")
    f = m.fields(b)
    version, _ = f.version(1)
    expected = f.count(2 if version == 0 else 4)
    entries = m.whole(f.at, b.end)
    for e in entries:
        refuse_unless(e.kind == "infe", "HEIF_ITEMS")
        f = m.fields(e)
        version, _ = f.version(3, 2)
        item = f.take(2 if version == 2 else 4)
        refuse_unless(f.take(2) == 0, "HEIF_PROTECTED")
        refuse_unless(f.at + 4 <= f.end, "HEIF_BOUNDS")
        m.items[item] = m.data[f.at : f.at + 4].decode("latin-1")
    refuse_unless(len(entries) == len(m.items) == len(expected), "HEIF_ITEMS")


def _sources(m: Heif) -> int:
    """Number of data sources, all of which must be this file."""
    dinf = m.one(m.children, "dinf", needed=False)
    if dinf is None:
        return 0
    inner = m.whole(dinf.body, dinf.end)
    refuse_unless([b.kind for b in inner] == ["dref"], "HEIF_SOURCES")
    f = m.fields(inner[0])
    refuse_unless(f.take(4) == 0, "HEIF_SOURCES")
    expected = f.count(4)
    entries = m.whole(f.at, inner[0].end)
    own = [e.kind == "url " and m.data[e.body : e.end] == b"\0\0\0\1" for e in entries]
    refuse_unless(len(entries) == len(expected) and all(own), "HEIF_SOURCES")
    return len(entries)


def _extents(m: Heif) -> None:
    sources = _sources(m)
    f = m.fields(m.one(m.children, "iloc"))
    version, _ = f.version(2)
    packed = f.take(2)
    offset_width, length_width, base_width, index_width = (packed >> s & 15 for s in (12, 8, 4, 0))
    index_width *= version > 0
    refuse_unless({offset_width, length_width, base_width, index_width} <= {0, 4, 8}, "HEIF_WIDTHS")
    wide = 4 if version == 2 else 2
    for _ in f.count(wide):
        item, method = f.take(wide), f.take(2) if version else 0
        source = f.take(2)
        refuse_unless(method in (0, 1) and (source == 0 or (method == 0 and source <= sources)), "HEIF_SOURCES")
        base, ranges = f.take(base_width), []
        for _ in f.count(2):
            refuse_unless(f.take(index_width) == 0, "HEIF_WIDTHS")
            ranges.append((base + f.take(offset_width), f.take(length_width)))
        refuse_unless(bool(ranges) and item not in m.extents, "HEIF_INDEX")
        m.extents[item] = Extents(method, source, ranges)
    f.done()
    refuse_unless(bool(m.extents), "HEIF_INDEX")


def _properties(m: Heif) -> None:
    b = m.one(m.children, "iprp")
    m.property_boxes = m.whole(b.body, b.end)
    values = m.one(m.property_boxes, "ipco")
    m.properties = m.whole(values.body, values.end)
    f = m.fields(m.one(m.property_boxes, "ipma"))
    version, flags = f.version(1)
    refuse_unless(flags in (0, 1), "HEIF_VERSION")
    width = 1 + flags
    essential = 1 << (8 * width - 1)
    for _ in f.count(4):
        item = f.take(4 if version else 2)
        found = [f.take(width) for _ in range(f.take(1))]
        refuse_unless(item not in m.links and all(1 <= v & (essential - 1) <= len(m.properties) for v in found), "HEIF_LINKS")
        m.links[item] = [(v & (essential - 1), bool(v & essential)) for v in found]
    f.done()


def _references(m: Heif) -> None:
    b = m.one(m.children, "iref", needed=False)
    if b is None:
        return
    f = m.fields(b)
    version, _ = f.version(1)
    width = 4 if version else 2
    for e in m.whole(f.at, b.end):
        f = m.fields(e)
        of = f.take(width)
        m.references.append((e.kind, of, [f.take(width) for _ in f.count(2)]))
        f.done()


def parse(data: bytes) -> Heif:
    """The relations of a file; ``Refused`` where they can't be read."""
    m = Heif(data)
    m.top = m.level(0, len(data))
    refuse_unless(bool(m.top), "HEIF_BOXES")
    rest = data[m.tail : m.tail + 8]
    refuse_unless(len(rest) < 8 or any(not 32 <= c <= 126 for c in rest[4:]), "HEIF_BOXES")  # anything else is a vendor's tail
    m.children = m.whole(m.meta.body + 4, m.meta.end)
    for read in (_extents, _items, _properties, _references):
        read(m)
    f = m.fields(m.one(m.children, "pitm"))
    version, _ = f.version(1)
    m.primary = f.take(4 if version else 2)
    f.done()
    refuse_unless(m.primary in m.items, "HEIF_PRIMARY")
    return m


# Rules: each takes the relations and tells whether they keep it.
def _brand(m: Heif) -> bool:
    first = m.top[0]
    return first.kind == "ftyp" and first.head == 8 and first.size >= 20 and m.data[first.at + 8 : first.at + 12] in BRANDS


def _grid(m: Heif) -> bool:
    if m.items[m.primary] != "grid":
        return True
    layout = m.payload(m.primary)
    if len(layout) not in (8, 12) or layout[0] or layout[1] & 254:
        return False
    wide = bool(layout[1])
    return len(layout) == (12 if wide else 8) and (layout[2] + 1) * (layout[3] + 1) == len(m.tiles) and struct.unpack(">II" if wide else ">HH", layout[4:]) == m.size


def _image_items(m: Heif) -> list[int]:
    return list(dict.fromkeys([*m.tiles, m.primary]))


def _image_properties(m: Heif, kind: str) -> list[bytes]:
    return [m.data[p.body : p.end] for i in _image_items(m) for p in m.of(i) if p.kind == kind]


def _no_hdr(m: Heif) -> bool:
    return not any(c[:4] == b"nclx" and (len(c) < 8 or int.from_bytes(c[6:8]) in HDR_TRANSFERS) for c in _image_properties(m, "colr"))


def _eight_bit(m: Heif) -> bool:
    """The decoder's configuration: profile Main or Main Still Picture, no more than 8 bits."""
    configs = [m.one(m.of(t), "hvcC") for t in m.tiles]
    bodies = [m.data[c.body : c.end] for c in configs]
    return all(len(b) >= 23 and b[1] & 31 in (1, 3) and not b[17] & 7 and not b[18] & 7 for b in bodies)


def _file_ranges(m: Heif) -> list[tuple[int, int, int, int]]:
    """(offset, length, item, number) of extents in the file, in order."""
    return sorted((at, n, item, i) for item, e in m.extents.items() if e.method == 0 for i, (at, n) in enumerate(e.ranges))


RULES: list[tuple[str, Callable[[Heif], bool]]] = [
    ("HEIF_TOO_LARGE", lambda m: len(m.data) <= MOST_BYTES),
    ("HEIF_DIMENSIONS", lambda m: min(m.size) > 0),
    ("HEIF_TOO_MANY_PIXELS", lambda m: m.size[0] * m.size[1] <= MOST_PIXELS),
    ("HEIF_BRAND", _brand),
    ("HEIF_SEQUENCE", lambda m: not any(b.kind in SEQUENCES for b in m.top) and m.data[m.meta.body] == 0),
    ("HEIF_TOP_LEVEL", lambda m: all(b.kind in TOP for b in m.top)),
    ("HEIF_EXTENSION", lambda m: all(b.kind in CHILDREN for b in m.children)),
    ("HEIF_INDEX", lambda m: len(m.property_boxes) == 2 and len(m.properties) <= MOST_ENTRIES and m.extents.keys() == m.items.keys()),
    ("HEIF_PRIMARY", lambda m: m.items[m.primary] in ("grid", "hvc1") and 1 <= len(m.tiles) <= MOST_TILES and len(set(m.tiles)) == len(m.tiles)),
    ("HEIF_AUXILIARY", lambda m: all(kind in REFERENCES for kind, _, _ in m.references)),
    ("HEIF_REFERENCES", lambda m: all({of, *to} <= m.items.keys() for _, of, to in m.references)),
    ("HEIF_SHARED", lambda m: not any(kind == "dimg" and of != m.primary and set(to) & set(m.tiles) for kind, of, to in m.references)),
    ("HEIF_GRID", _grid),
    ("HEIF_PROPERTY", lambda m: all(p.kind in PROPERTIES for i in _image_items(m) for p in m.of(i))),
    ("HEIF_COLOUR", lambda m: all(c[:4] in COLOURS for c in _image_properties(m, "colr"))),
    ("HEIF_HDR", _no_hdr),
    ("HEIF_DEPTH", lambda m: all(p == b"\0\0\0\0\3\x08\x08\x08" for p in _image_properties(m, "pixi"))),
    ("HEIF_CODEC", lambda m: all(m.items[t] == "hvc1" for t in m.tiles)),
    ("HEIF_EIGHT_BIT", _eight_bit),
    ("HEIF_EXTENT_BOUNDS", lambda m: all(at >= m.mdat.body and n > 0 and at + n <= m.mdat.end for at, n, _, _ in _file_ranges(m))),
    ("HEIF_EXTENT_OVERLAP", lambda m: all(a[0] + a[1] <= b[0] for a, b in pairwise(_file_ranges(m)))),
]


def admitted(data: bytes) -> Heif:
    """The relations of a file that keeps all rules."""
    m = parse(data)
    for reason, kept in RULES:
        refuse_unless(kept(m), reason)
    return m


def reason(data: bytes) -> str | None:
    try:
        admitted(data)
    except Refused as e:
        return str(e)
    return None


# Rebuilding.
def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def _new_links(m: Heif, configs: dict[int, int]) -> bytes:
    out = [struct.pack(">II", 0x01000001, len(m.links))]
    for item, links in m.links.items():
        out.append(struct.pack(">IB", item, len(links)))
        for index, essential in links:
            if item in configs and m.properties[index - 1].kind == "hvcC":
                index = configs[item]
            out.append(struct.pack(">H", index | essential << 15))
    return box("ipma", *out)


def _new_index(m: Heif, places: dict[tuple[int, int], tuple[int, int]], base: int) -> bytes:
    """Extents with absolute offsets of 4 bytes; ``places`` count from ``base``."""
    out = [struct.pack(">IHI", 0x02000000, 0x4400, len(m.extents))]
    for item, e in m.extents.items():
        out.append(struct.pack(">IHHH", item, e.method, e.source, len(e.ranges)))
        for i, own in enumerate(e.ranges):
            at, n = places.get((item, i), own)
            out.append(struct.pack(">II", at + base if e.method == 0 else at, n))
    return box("iloc", *out)


def rebuild(original: bytes, encoded: bytes, packet: str) -> bytes:
    """``original`` with the image data of ``encoded`` and a packet; ``Refused`` where both don't fit together."""
    old, new = admitted(original), admitted(encoded)
    grid = old.items[old.primary] == "grid"
    refuse_unless(old.size == new.size and grid == (new.items[new.primary] == "grid") and len(old.tiles) == len(new.tiles), "HEIF_OTHER_GRID")
    refuse_unless(not grid or old.payload(old.primary) == new.payload(new.primary), "HEIF_OTHER_GRID")
    properties, configs, fresh = [old.raw(p) for p in old.properties], {}, {}
    for a, b in zip(old.tiles, new.tiles, strict=True):
        refuse_unless(old.extents[a].method == 0 and len(old.extents[a].ranges) == 1, "HEIF_SPLIT_TILE")
        refuse_unless(old.size_of(a) == new.size_of(b), "HEIF_OTHER_TILES")
        fresh[a] = new.payload(b)
        config = new.raw(new.one(new.of(b), "hvcC"))
        if config not in properties:
            properties.append(config)
        configs[a] = properties.index(config) + 1
    refuse_unless(len(properties) < 1 << 15, "HEIF_ENTRIES")
    body, places, at = bytearray(), {}, old.mdat.body
    for start, n, item, i in _file_ranges(old):
        body += original[at:start]
        value = fresh.get(item, original[start : start + n])
        places[item, i] = len(body), len(value)
        body += value
        at = start + n
    body += original[at : old.mdat.end]

    def meta(base: int) -> bytes:
        made = {"iloc": _new_index(old, places, base), "iprp": box("iprp", box("ipco", *properties), _new_links(old, configs))}
        return box("meta", original[old.meta.body : old.meta.body + 4], *[made.get(c.kind) or old.raw(c) for c in old.children])

    size, base = len(meta(0)), 8
    for b in old.top[: old.top.index(old.mdat)]:
        base += size if b is old.meta else b.size
    parts = [meta(base) if b is old.meta else box("mdat", bytes(body)) if b is old.mdat else old.raw(b) for b in old.top]
    out = b"".join(parts) + box("uuid", XMP_UUID, packet.encode()) + original[old.tail :]
    refuse_unless(_same_but_tiles(old, admitted(out), fresh), "HEIF_REBUILD")
    return out


def _same_but_tiles(old: Heif, new: Heif, fresh: dict[int, bytes]) -> bool:
    """Whether every relation is kept, and every payload and property but the tiles' own."""
    kept = lambda m: [m.raw(c) for c in m.children if c.kind not in ("iloc", "iprp")]
    values = lambda m, i: [m.raw(p) for p in m.of(i) if i not in fresh or p.kind != "hvcC"]
    relations = (old.items, old.references, old.primary, old.size, kept(old)) == (new.items, new.references, new.primary, new.size, kept(new))
    sources = {i: e.source for i, e in old.extents.items()} == {i: e.source for i, e in new.extents.items()}
    payloads = all(new.payload(i) == fresh.get(i, old.payload(i)) for i in old.items)
    return relations and sources and payloads and all(values(old, i) == values(new, i) for i in old.links) and old.data[old.tail :] == new.data[new.tail :]


# Columns.
RELATIONS = """struct<reason:string,primary:long,width:long,height:long,items:array<struct<id:long,type:string>>,extents:array<struct<id:long,method:int,offset:long,length:long>>,
links:array<struct<id:long,property:string,essential:boolean>>,references:array<struct<type:string,of:long,to:long>>,tiles:array<long>>"""


def _relations(data: bytes) -> dict:
    try:
        m = admitted(data)
    except Refused as e:
        return {"reason": str(e)}
    return {
        "reason": None,
        "primary": m.primary,
        "width": m.size[0],
        "height": m.size[1],
        "items": [{"id": i, "type": t} for i, t in m.items.items()],
        "extents": [{"id": i, "method": e.method, "offset": at, "length": n} for i, e in m.extents.items() for at, n in e.ranges],
        "links": [{"id": i, "property": m.properties[p - 1].kind, "essential": s} for i, found in m.links.items() for p, s in found],
        "references": [{"type": k, "of": of, "to": to} for k, of, found in m.references for to in found],
        "tiles": m.tiles,
    }


def reason_column(c: Column) -> Column:
    """Reason code, null for files that are processed."""
    return column(reason, "string")(c)


def relations_column(c: Column) -> Column:
    """The relations of a file as arrays; ``reason`` alone for a file that isn't processed."""
    import pandas as pd
    from pyspark.sql import functions as F

    names = ["reason", "primary", "width", "height", "items", "extents", "links", "references", "tiles"]

    def frame(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(names) | (_relations(bytes(x)) if x is not None else {}) for x in s], columns=names, dtype=object)

    frame.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(frame, RELATIONS.replace("\n", ""))(c)


def other_items(items: Column, tiles: Column) -> Column:
    """Ids of the items that aren't tiles."""
    from pyspark.sql import functions as F

    return F.array_except(items["id"], tiles)
