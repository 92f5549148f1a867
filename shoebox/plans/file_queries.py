"""Queries that write and read files: windows, digests, backups, the journal; and whole PNG, JPEG and MP4 files that are
made from numbers. The oracles return the generators' parameters."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import containers as C
from ..functions import png as P
from ..sources import files, journal
from ..sources.driver import Driver
from .binary_queries import box, join, jpegs, mp4s, raw, u
from .registry import query
from .text_queries import numbers

_LENGTH = "CASE WHEN s % 20 = 0 THEN 5000000 ELSE s % 5 * 100000 END + s"
_S = f", q AS (SELECT s, ({_LENGTH})::BIGINT AS n, 'x/' || s % 3 || '/' || s || '.bin' AS path FROM (SELECT s_suppkey AS s FROM supplier)), w AS (SELECT *, repeat(chr(97 + (s % 26)::INT), n) AS c FROM q) "


#: Bytes of media files that are there at one time (some; one file at least), beside what a query writes from them.
WAVE_BYTES = 512 << 20


def once(d: Driver, df: DataFrame, at: str) -> DataFrame:
    """``df`` computed now, as its tasks change files."""
    df.write.parquet(at)
    return d.spark.read.schema(df.schema).parquet(at)


def in_waves(d: Driver, f: Callable[[str, str, DataFrame], DataFrame]) -> DataFrame:
    """``f`` of the media files, one for each supplier, wave by wave: all of them are written, but not kept at one time.

    ``f`` gets the folder of a wave's files, one for what it writes itself (not there yet), and the files: s, path, at (the
    whole path). When its result is written, both folders go. Folders and files that nothing reads are left out: Hadoop's
    local file system starts a process for each one that Spark makes, which for a moment counts the JVM's memory twice.
    """
    rows = d.table("supplier").select(F.col("s_suppkey").alias("s"))
    rows = rows.withColumn("path", F.concat(F.lit("x/"), (F.col("s") % 3).cast("string"), F.lit("/"), F.col("s").cast("string"), F.lit(".bin")))
    rows = rows.withColumn("n", F.expr(_LENGTH).cast("long"))
    waves = -(-(rows.agg(F.sum("n")).first()[0] or 0) // WAVE_BYTES) or 1
    rows, planned = rows.withColumn("wave", F.pmod(F.xxhash64("s"), F.lit(waves)).cast("int")), d.workspace()
    rows.repartition("wave").write.partitionBy("wave").parquet(planned)
    rows = d.spark.read.schema(rows.schema).parquet(planned)
    result, schema = d.workspace(), None
    for k in range(waves):
        at = d.workspace()
        root, own = f"{at}/files", f"{at}/own"
        try:
            share = rows.filter(F.col("wave") == k).repartition(2 * d.spark.sparkContext.defaultParallelism, "s")
            runs = files.write_runs(share.select("path", (97 + F.col("s") % 26).cast("int").alias("byte"), "n"), root)
            runs.write.format("noop").mode("overwrite").save()
            if not d.exists(root):
                d.folder(root)
            out = f(root, own, share.select("s", "path", F.concat(F.lit(root + "/"), "path").alias("at")))
            out.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(result)
            schema = out.schema
        finally:
            d.remove(at)
    return d.spark.read.schema(schema).parquet(result)


def window_digests(rows: DataFrame, head: int, tail: int) -> DataFrame:
    """s, length and the digests of both windows of files (s, at). Windows are digested where they are read: what is
    joined, and may be broadcast, holds no bytes of a file."""
    got = files.windows(rows.select(F.col("at").alias("path")), head, tail)
    got = got.select(F.col("path").alias("at"), "length", F.sha2("head", 256).alias("head"), F.sha2("tail", 256).alias("tail"))
    return rows.join(got, "at").select("s", "length", "head", "tail")


def _windows(d: Driver, head: int, tail: int) -> DataFrame:
    return in_waves(d, lambda root, own, rows: window_digests(rows, head, tail))


query("s12_header_bytes", _S + f"SELECT s, n AS length, sha256(left(c, {files.HEADER})) AS head, sha256('') AS tail FROM w")(lambda d: _windows(d, files.HEADER, 0))
query("s13_head_and_tail", _S + f"SELECT s, n AS length, sha256(left(c, {files.WINDOW})) AS head, sha256(right(c, {files.WINDOW})) AS tail FROM w")(lambda d: _windows(d, files.WINDOW, files.WINDOW))
query("s14_tail_window", _S + f"SELECT s, n AS length, sha256('') AS head, sha256(right(c, {files.TAIL})) AS tail FROM w")(lambda d: _windows(d, 0, files.TAIL))
query("a13_folder_size", _S + "SELECT sum(n)::BIGINT AS bytes FROM q")(lambda d: files.total_size(in_waves(d, lambda root, own, rows: files.listing(d.spark, root))))
query("s18_untracked", _S + "SELECT path FROM q WHERE s % 4 <> 1")(
    lambda d: in_waves(d, lambda root, own, rows: files.untracked(files.listing(d.spark, root), rows.filter("s % 4 = 1")).select("path"))
)


@query("f27_file_digests", _S + "SELECT s, n AS length, sha256(c) AS sha FROM w")
def _(d: Driver) -> DataFrame:
    def run(root: str, own: str, rows: DataFrame) -> DataFrame:
        got = files.digests(rows.select(F.col("at").alias("path"))).withColumnRenamed("path", "at")
        return rows.join(got, "at").select("s", "length", "sha")

    return in_waves(d, run)


@query("k17_copies", _S + "SELECT s, n AS length, sha256(c) AS sha, n AS copied FROM w")
def _(d: Driver) -> DataFrame:
    def run(root: str, own: str, rows: DataFrame) -> DataFrame:
        to = d.folder(f"{own}/to")
        made = once(d, files.copies(rows.select(F.col("at").alias("source"), F.concat(F.lit(to + "/"), "path").alias("target"))), f"{own}/made")
        there = files.listing(d.spark, to).select("path", F.col("length").alias("copied"))
        return rows.join(made, rows["at"] == made["source"]).join(there, "path").select("s", "length", "sha", "copied")

    return in_waves(d, run)


@query("k18_k19_backups", _S + "SELECT s, sha256(c) AS sha, CASE WHEN s % 2 = 0 THEN 'FREED' WHEN s % 3 = 0 THEN 'REFUSED' ELSE 'DONE' END AS outcome, CASE WHEN s % 2 = 0 THEN n ELSE 0 END AS freed, s % 2 <> 0 AS there FROM w")
def _(d: Driver) -> DataFrame:
    def run(_: str, own: str, rows: DataFrame) -> DataFrame:
        root = d.folder(f"{own}/bin")
        done = once(d, files.back_up(rows.select(F.col("s").cast("string").alias("id"), F.col("at").alias("source")), root), f"{own}/done")
        name = F.when(F.col("id").cast("long") % 2 == 0, F.col("backup")).when(F.col("id").cast("long") % 3 == 0, F.concat(F.lit("x/../"), F.col("backup")))
        gone = once(d, files.delete_backups(done.select(name.alias("backup")).filter("backup IS NOT NULL"), root), f"{own}/gone")
        gone = gone.select(F.regexp_replace("backup", r"^x/\.\./", "").alias("backup"), "freed", F.col("outcome").alias("removal"))
        there = files.listing(d.spark, root).select(F.col("path").alias("backup"), F.lit(True).alias("there"))
        out = done.join(gone, "backup", "left").join(there, "backup", "left")
        return out.select(F.col("id").cast("long").alias("s"), "sha", F.coalesce("removal", "outcome").alias("outcome"), F.coalesce("freed", F.lit(0)).cast("long").alias("freed"), F.coalesce("there", F.lit(False)).alias("there"))

    return in_waves(d, run)


# The journal: as many documents as there are pending recoveries, each written on its own.
def _begun(d: Driver) -> str:
    at = d.workspace()
    for r in d.journal().toLocalIterator():
        entry = {"id": r.id, "path": r.path, "backup": r.backup, "sha256": "s-" + r.id, "mtime": "2024-01-01T00:00:00.1Z", "uri": r.media_uri, "taken": r.taken, "added": r.added, "modified": r.modified}
        more = {"safety": r.safety, "convertedPath": r.converted_path, "dateRestorePendingReason": r.date_pending_reason}
        journal.begin(d.spark, at, entry | {k: v for k, v in more.items() if v is not None})
    return at


query("s11_k15_journal", "SELECT id, path, backup, 's-' || id AS sha256, media_uri, taken, added, modified, safety, id AS ledger_id, false AS taken_null, converted_path, date_pending_reason FROM journal")(
    lambda d: journal.read(d.spark, _begun(d)).select("id", "path", "backup", "sha256", "media_uri", "taken", "added", "modified", "safety", "ledger_id", "taken_null", "converted_path", "date_pending_reason")
)


@query("k16_journal_finish", "SELECT id FROM journal WHERE pos % 3 <> 0")
def _(d: Driver) -> DataFrame:
    at = _begun(d)
    for r in d.journal().filter("pos % 3 = 0").select("id").toLocalIterator():
        journal.finish(d.spark, at, r.id)
    return journal.read(d.spark, at).select("id")


# PNG files, made row by row with each of the filters.
def make_png(k: int) -> bytes:
    """A file of pixels (k + 3 y + x) % 256; every 7th has a wrong checksum, every 11th a filter that doesn't
    exist. Every other has its XMP in a packed text, stored without compression so that its size is known."""
    channels = 3 if k % 2 else 1
    w, h = (1 + k % 4) * channels, 1 + k % 3
    lines, above = b"", [0] * w
    for y in range(h):
        row, kind = [(k + 3 * y + x) % 256 for x in range(w)], (k + y) % 5
        out = []
        for x in range(w):
            left, up, corner = row[x - channels] if x >= channels else 0, above[x], above[x - channels] if x >= channels else 0
            p = left + up - corner
            near = min((left, up, corner), key=lambda v: abs(p - v))
            out.append((row[x] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        lines += bytes([7 if k % 11 == 4 and y == h - 1 else kind, *out])
        above = row
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    text = part(b"iTXt", P.XMP_KEYWORD + b"\0\1\0\0\0" + zlib.compress(f"<p k={k}/>".encode(), 0)) if k % 2 else part(b"tEXt", P.XMP_KEYWORD + b"\0" + f"<p k={k}/>".encode())
    data = C.PNG_SIGNATURE + part(b"IHDR", struct.pack(">iiBBBBB", w // channels, h, 8, 2 if k % 2 else 0, 0, 0, 0)) + text + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    return data[:-1] + bytes([data[-1] ^ 1]) if k % 7 == 3 else data


def made(f, kind: str = "binary"):
    """A column made from numbers by ``f``."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda k: f(int(k)))

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)


def whole_pngs(d: Driver) -> DataFrame:
    return numbers(d).select("k", made(make_png)(F.col("k")).alias("content"))


_PNG = ", n AS (SELECT o_orderkey AS k, CASE WHEN k % 7 = 3 THEN 'PNG_CHUNK_CRC' WHEN k % 11 = 4 THEN 'PNG_FILTER' END AS reason, CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END AS ch, 1 + k % 4 AS w, 1 + k % 3 AS h FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)) "
query(
    "b28_b29_png_files",
    _PNG + "SELECT k, reason, CASE WHEN reason IS NULL THEN w END AS width, CASE WHEN reason IS NULL THEN h END AS height, CASE WHEN reason IS NULL THEN list_sum(flatten(list_transform(range(h), lambda y: list_transform(range(w * ch), lambda x: (k + 3 * y + x) % 256))))::BIGINT END AS pixels FROM n",
)(lambda d: whole_pngs(d).select("k", P.facts_column(F.col("content")).alias("f")).select("k", "f.reason", "f.width", "f.height", "f.pixels"))
query("b30_png_xmp", _PNG + "SELECT k, CASE WHEN reason IS DISTINCT FROM 'PNG_CHUNK_CRC' THEN '<p k=' || k || '/>' END AS xmp FROM n")(lambda d: whole_pngs(d).select("k", C.column(P.packet, "string")(F.col("content")).alias("xmp")))
_META = "25 + 12 + 12 + 18 + length('<p k=' || k || '/>') + CASE WHEN k % 2 = 0 THEN 0 ELSE 15 END"
query("a18_b31_png_archive", _PNG + f"SELECT k, CASE WHEN ok THEN {_META} END AS metadata, CASE WHEN ok THEN 8 + {_META} END AS archived, CASE WHEN ok THEN true END AS same FROM (SELECT *, reason IS DISTINCT FROM 'PNG_CHUNK_CRC' AS ok FROM n)")(
    lambda d: whole_pngs(d).select("k", C.column(P.archived, "struct<metadata:long,archived:long,same:boolean>")(F.col("content")).alias("a")).select("k", "a.metadata", "a.archived", "a.same")
)

# JPEG and multi-picture files.
query("b6_assemble", "SELECT o_orderkey AS k, true AS same FROM orders")(
    lambda d: jpegs(d).select("k", C.column(lambda b: (lambda parts, at: C.assemble([(m, p) for _, m, p in parts], b[at:]) == b)(*C.header_segments(b)), "boolean")(F.col("content")).alias("same"))
)
_XMP = '<Container:Item Item:Semantic="Primary" Item:Length="9"/>'


def _scan(n: int) -> bytes:
    return b"\xff\xda\0\3z" + b"s" * n + b"\xff\xd9"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _mpf(entries: list[tuple[int, int]]) -> bytes:
    """A table of (size, offset)."""
    table = b"".join(struct.pack(">IIIHH", 0, size, offset, 0, 0) for size, offset in entries)
    head = C.MPF + b"MM\0\x2a" + struct.pack(">IH", 8, 2)
    return head + struct.pack(">HHII", 0xB001, 4, 1, len(entries)) + struct.pack(">HHII", 0xB002, 7, len(table), 38) + struct.pack(">I", 0) + table


def make_mpf(k: int) -> bytes:
    other = b"\xff\xd8" + _scan(k % 50)
    head = b"\xff\xd8" + _segment(C.APP1, C.XMP + _XMP.encode())
    whole = lambda size, offset: head + _segment(C.APP2, _mpf([(size, 0), (len(other), offset)])) + _scan(k % 70)
    size = len(whole(1, 0))
    return whole(size, size - len(head) - 8) + other


_END = len(make_mpf(0)) - 9
query("b10_mpf_plan", f"SELECT o_orderkey AS k, {_END} + o_orderkey % 70 AS primary_end, {_END} + o_orderkey % 70 AS start, 9 + o_orderkey % 50 AS size FROM orders")(
    lambda d: numbers(d).select("k", C.column(lambda b: (p[0], *p[1][0]) if (p := C.mpf_plan(b)) else None, "struct<primary_end:long,start:long,size:long>")(made(make_mpf)(F.col("k"))).alias("p")).select("k", "p.primary_end", "p.start", "p.size")
)


def _rebuilt(k: int, original: bytes):
    encoded = b"\xff\xd8" + _segment(0xDB, b"q" * (k % 300)) + _scan(k % 40)
    out = C.mpf_rebuild(original, encoded, _XMP)
    end, others = C.mpf_plan(out)
    return {"size": others[0][1], "named": f'Item:Length="{end}"' in C.xmp_text(out), "tail": out.endswith(b"\xff\xd8" + _scan(k % 50)), "grown": end - len(encoded)}


def _rebuild(k: pd.Series, original: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_rebuilt(int(i), bytes(o)) for i, o in zip(k, original, strict=True)])


#: What the header adds to an encoded image: XMP and table segments, and two or three digits for the one in the text.
_ADDED = 4 + len(C.XMP) + len(_XMP) - 1 + 4 + len(_mpf([(0, 0), (0, 0)]))
query("b11_mpf_rebuild", f"SELECT k, 9 + k % 50 AS size, true AS named, true AS tail, {_ADDED} + 3 AS grown FROM (SELECT o_orderkey AS k FROM orders)")(
    lambda d: numbers(d).select("k", F.pandas_udf(_rebuild, "struct<size:long,named:boolean,tail:boolean,grown:long>")(F.col("k"), made(make_mpf)(F.col("k"))).alias("r")).select("k", "r.size", "r.named", "r.tail", "r.grown")
)


def _updated(k: int):
    out = C.mpf_update(_mpf([(5, 0), (6, 7)]), [k % 9, k + 2], [0, k + 1000], 8 + k % 10)
    return out and [{"size": s, "offset": o} for _, s, o, _, _ in C.mpf_entries(out)]


query("b9_mpf_update", "SELECT k, CASE WHEN k % 9 <> 0 THEN k % 9 END AS first_size, CASE WHEN k % 9 <> 0 THEN k + 2 END AS size, CASE WHEN k % 9 <> 0 THEN k + 1000 - 12 - k % 10 END AS offset FROM (SELECT o_orderkey AS k FROM orders)")(
    lambda d: numbers(d).select("k", made(_updated, "array<struct<size:long,offset:long>>")(F.col("k")).alias("e")).select("k", F.get("e", 0)["size"].alias("first_size"), F.get("e", 1)["size"].alias("size"), F.get("e", 1)["offset"].alias("offset"))
)

# MP4 files.
query("b36_top_level_marker", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'packet ' || o_orderkey END AS packet FROM orders")(
    lambda d: numbers(d)
    .select("k", join(box("ftyp", raw(b"isom\0\0\0\1")), F.when(F.col("k") % 3 == 0, raw(b"")).otherwise(box("uuid", join(raw(C.XMP_UUID), F.concat(F.lit("packet "), F.col("k").cast("string")).cast("binary")))), box("mdat", raw(b"vv"))).alias("c"))
    .select("k", C.column(C.top_level_packet, "string")(F.col("c")).alias("packet"))
)


def _products(d: Driver) -> DataFrame:
    """Sources and targets: a target has its own times and chunk offsets, and no metadata."""
    stco = box("stco", join(raw(b"\0\0\0\0"), u(1, 4), u(F.col("k") + 5000, 4)))
    moov = box("moov", join(box("mvhd", raw(b"\0" * 24)), box("trak", box("mdia", box("minf", box("stbl", stco))))))
    return mp4s(d).select("k", F.col("content").alias("source"), join(box("ftyp", raw(b"isom\0\0\0\1")), moov, box("mdat", raw(b"video"))).alias("target"))


def _injected(target: pd.Series, source: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s in zip(target, source, strict=True):
        out = C.inject_metadata(bytes(t), bytes(s))
        at = out.find(b"stco")
        rows.append((*C.mvhd_times(out), sum(n for _, _, n in C.meta_boxes(out)), int.from_bytes(out[at + 12 : at + 16]), C.is_plain_mp4(out)))
    return pd.DataFrame(rows, columns=["created", "modified", "extra", "first", "whole"])


query("b40_inject", "SELECT o_orderkey AS k, o_orderkey + 100 AS created, o_orderkey + 200 AS modified, 8 + o_orderkey % 9 AS extra, o_orderkey + 5000 + 8 + o_orderkey % 9 AS first, true AS whole FROM orders")(
    lambda d: _products(d).select("k", F.pandas_udf(_injected, "struct<created:long,modified:long,extra:long,first:long,whole:boolean>")("target", "source").alias("i")).select("k", "i.created", "i.modified", "i.extra", "i.first", "i.whole")
)
