"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``. Behind the
frames stand two skippable frames: an index that maps record ids to (frame,
offset within the frame, length), and the footer seek table with the compressed
and decompressed size of each frame. A reader opens the footer, then reads single
frames or single records.

Each task writes files of its own, named by partition and attempt; only the files
named in the manifest that successful tasks return are ever read, so retried and
speculative attempts do no harm.

Defined cases: a null payload is empty; null url gives an empty target URI; rows
that repeat the smallest page_id of a payload are all responses; payloads whose
page_ids are all null are responses; a null page_id reads back as null; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, lean, materialize, open_read, open_write, scratch, sized, task_tag

FRAME_BYTES = 1 << 18
#: A file is closed beyond this size, whatever its partition holds.
FILE_BYTES = 1 << 30
REVISIT_LEAST = 100
# Fixed values of the seekable format: magic of a skippable frame (variants E and D), magic of the footer.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:"


def urn(page_id: int | None, digest: str) -> str:
    """A record's id, of page and payload: only rows that repeat both share it, and a revisit can name its response's."""
    return f"{_page(page_id)}{digest[:32]}>"


def _from_urn(value: str) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]+>", value)
    return int(got[1]) if got else None


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, offset behind the record)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end where it says")
    return headers, data[start:stop], stop + 4


def facts_of(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record as read."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["WARC-Type"]
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (length != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    return _from_urn(headers["WARC-Record-ID"]), length, digest, kind, _from_urn(headers.get("WARC-Refers-To", ""))


class Writer:
    """Writes one bundle."""

    def __init__(self, uri: str):
        self.uri, self.out, self.size = uri, open_write(uri), 0
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.index, self.records = bytearray(), [], 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append(f"{len(self.frames)} {len(self.buffer)} {len(data)} {record_id}")
        self.buffer += data
        self.records += 1
        if len(self.buffer) >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        if self.buffer:
            packed = self.packer.compress(bytes(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.size += len(packed)
            self.buffer = bytearray()

    def close(self) -> tuple[str, int, int]:
        self._frame()
        body = self.packer.compress("\n".join(self.index).encode())
        index = struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body
        seek = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        tail = index + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek
        self.out.write(tail)
        self.out.close()
        return self.uri, self.records, self.size + len(tail)


def footer(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of an open bundle."""
    file.seek(-9, 2)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(-9 - 8 * count, 2)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(file) -> dict[str, list[tuple[int, int, int]]]:
    """Record id -> (frame, offset within the frame, length) of its records."""
    end = sum(x[1] for x in footer(file))
    file.seek(end)
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE_INDEX:
        raise ValueError("no record index")
    out: dict[str, list[tuple[int, int, int]]] = {}
    for line in zstandard.ZstdDecompressor().decompress(file.read(size)).decode().split("\n"):
        if line:
            frame, at, length, key = line.split(" ", 3)
            out.setdefault(key, []).append((int(frame), int(at), int(length)))
    return out


def read_frame(file, at: int, packed: int, plain: int) -> bytes:
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def lookup(uri: str, page_id: int | None) -> list[tuple[dict[str, str], bytes]]:
    """The records of one page in one bundle; reads the footer, the index and single frames."""
    with open_read(uri) as f:
        frames = footer(f)
        places = [x for key, found in record_index(f).items() if key.startswith(_page(page_id)) for x in found]
        return [parse(read_frame(f, *frames[n]), at)[:2] for n, at, _ in places]


MANIFEST = "path string, n_records long, n_bytes long"
FRAME = "path string, at long, packed long, plain long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _writer(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, w, n = [], None, 0
        for b in batches:
            for page_id, url, html, digest, head, revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if w is None:
                    w, n = Writer(f"{root}/{task_tag()}-{n:04d}.warc.zst"), n + 1
                w.add(urn(page_id, digest), record(page_id, url, html, digest, head, revisit))
                if w.size >= file_bytes:
                    done.append(w.close())
                    w = None
        if w is not None:
            done.append(w.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return write


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            with open_read(path) as f:
                got = footer(f)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got)), *(pa.array(x, pa.int64()) for x in zip(*got, strict=True))], names=["path", "at", "packed", "plain"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in RECORD.split(", ")]
    for b in batches:
        for path, at, packed, plain in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            with open_read(path) as f:
                data = read_frame(f, at, packed, plain)
            rows, here = [], 0
            while here < len(data):
                headers, block, here = parse(data, here)
                rows.append(facts_of(headers, block))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_archives(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles under ``root``; the manifest of the files."""
    bounded_batches(pages)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = F.octet_length("payload") >= REVISIT_LEAST
    # Short payloads never meet: their key is their own row's, so a crowd of empty pages isn't one group.
    rows = rows.withColumn("key", F.when(shared, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    heads = (
        pages.select("page_id", payload.alias("payload"))
        .filter(shared)
        .groupBy(F.sha2("payload", 256).alias("key"))
        .agg(F.min("page_id").alias("head"), F.count("*").alias("n"))
        .filter("n > 1 AND head IS NOT NULL")
        .drop("n")
    )
    heads = sized(heads, "warc-heads")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    joined = rows.join(heads, "key", "left").select("page_id", "url", "payload", "digest", "head", revisit.alias("revisit"))
    return materialize(joined.mapInArrow(lean(_writer(root, file_bytes)), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, from the files of the manifest; frames are dealt out evenly."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = manifest.select("path").mapInArrow(lean(_frames), FRAME)
    return frames.repartition(n).mapInArrow(lean(_records), RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, scratch(spark, "warc")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN h.head IS NULL OR p.page_id IS NOT DISTINCT FROM h.head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM h.head THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND p.payload_bytes >= 100
"""
