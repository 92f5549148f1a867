"""Files as rows: listings, windows of their bytes, copies with digests, backups.

Contents that fit into a row come from Spark's ``binaryFile``. Whatever may be larger than a row
(videos) is never read whole: windows are range reads, copies and digests go through a buffer of
fixed size, in Python tasks that open the files themselves. Paths are those of a file system that
all executors reach.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, TAIL, WINDOW, BUFFER = 256 * 1024, 512 * 1024, 2 << 20, 256 * 1024
#: Bytes of contents in an Arrow batch that leaves a task, beside those of its last row. A task holds them several times over,
#: in Python, on the way and in the JVM; in a local session, all tasks' are in the driver.
BATCH_BYTES = 4 << 20


class Store:
    """The file system behind a path: local, or what pyarrow opens by the path's scheme."""

    def __init__(self, path: str):
        u = urlparse(path)
        self.fs, self.local = None, u.path if u.scheme else path
        if u.scheme not in ("", "file"):
            from pyarrow import fs

            # Hadoop's names of a scheme that pyarrow knows by another.
            known = {"s3a": "s3", "s3n": "s3"}.get(u.scheme, u.scheme)
            self.fs, self.local = fs.FileSystem.from_uri(known + path[len(u.scheme) :])

    def size(self) -> int | None:
        """Bytes of a regular file; None where there is none. A link isn't a regular file."""
        if self.fs is None:
            return os.path.getsize(self.local) if os.path.isfile(self.local) and not os.path.islink(self.local) else None
        info = self.fs.get_file_info(self.local)
        return info.size if info.is_file else None

    def read(self):
        return open(self.local, "rb") if self.fs is None else self.fs.open_input_file(self.local)

    def write(self):
        if self.fs is None:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            return open(self.local, "wb")
        self.fs.create_dir(os.path.dirname(self.local), recursive=True)
        return self.fs.open_output_stream(self.local)

    def remove(self) -> None:
        os.remove(self.local) if self.fs is None else self.fs.delete_file(self.local)

    def linked(self, root: str) -> bool:
        """Whether the file, or a folder above it and below ``root``, is a link."""
        if self.fs is not None:
            return False
        at, top = self.local, Store(root).local.rstrip("/")
        while len(at) > len(top):
            if os.path.islink(at):
                return True
            at = os.path.dirname(at)
        return False


def by_row(df: DataFrame, f: Callable[..., tuple], result: str) -> DataFrame:
    """``f`` of each row of ``df``, whose batches leave the task when they hold ``BATCH_BYTES``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, held = to_arrow_schema(schema), [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(f(*row))
                held += sum(len(x) for x in out[-1] if isinstance(x, bytes))
                if held >= BATCH_BYTES or len(out) >= 10_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of all files below ``path``; a content must fit into a row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length), relative to ``path``; contents aren't read. Spark lists folders in a task each, if it
    isn't held to fewer: those of one file would cost more than what is done with it."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, 2 * spark.sparkContext.defaultParallelism)
    try:
        rows = read_bytes(spark, path).select("path", "length")
    finally:
        spark.conf.set(name, before)
    root = path.removeprefix("file://").rstrip("/") + "/"
    return rows.select(F.substring_index("path", root, -1).alias("path"), "length")


def untracked(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path) that ``known`` (path) doesn't name."""
    return files.join(known.select("path").filter("path IS NOT NULL").distinct(), "path", "left_anti")


def total_size(files: DataFrame) -> DataFrame:
    """One row."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def header(content: Column) -> Column:
    """S12 of a content in a row: the first 256 KiB."""
    return F.substring(content, 1, HEADER)


def tail(content: Column) -> Column:
    """S14 of a content in a row: the last 512 KiB."""
    return F.when(F.length(content) > TAIL, F.substring(content, -TAIL, TAIL)).otherwise(content)


def windows(files: DataFrame, head: int = HEADER, tail: int = 0) -> DataFrame:
    """(path, length, head, tail) of files (path) of any size, of which only the first ``head`` and the
    last ``tail`` bytes are read; where both meet they overlap. A file that can't be read has nulls."""

    def read(path: str | None):
        try:
            with Store(path).read() as f:
                f.seek(0, 2)
                size = f.tell()
                f.seek(0)
                first = f.read(min(head, size))
                f.seek(max(0, size - tail))
                return path, size, first, f.read(min(tail, size))
        except (OSError, AttributeError, TypeError):
            return path, None, None, None

    return by_row(files.select("path"), read, "path string, length long, head binary, tail binary")


def _copy(source: str, to: str | None) -> tuple[int, str]:
    """(bytes, SHA-256) of a file, read once through a buffer and, where ``to`` is given, written there."""
    digest, n = hashlib.sha256(), 0
    out = Store(to).write() if to else None
    try:
        with Store(source).read() as f:
            while part := f.read(BUFFER):
                digest.update(part)
                n += len(part)
                if out:
                    out.write(part)
    finally:
        if out:
            out.close()
    return n, digest.hexdigest()


def digests(files: DataFrame) -> DataFrame:
    """(path, length, sha) of files (path) of any size."""
    return by_row(files.select("path"), lambda path: (path, *_copy(path, None)), "path string, length long, sha string")


def with_digest(files: DataFrame) -> DataFrame:
    """F27 of contents in rows."""
    return files.withColumn("sha", F.sha2("content", 256))


def copies(files: DataFrame) -> DataFrame:
    """Copy each file (source, target) and take its digest on the way: (source, target, length, sha)."""
    return by_row(files.select("source", "target"), lambda a, b: (a, b, *_copy(a, b)), "source string, target string, length long, sha string")


def write_contents(rows: DataFrame, root: str) -> DataFrame:
    """Write each row's content (path below ``root``, content): (path, length)."""

    def write(path: str, content: bytes):
        with Store(safe_path(root, path)).write() as f:
            f.write(content)
        return path, len(content)

    return by_row(rows.select("path", "content"), write, "path string, length long")


def write_runs(rows: DataFrame, root: str) -> DataFrame:
    """Write files of one byte n times (path below ``root``, byte int, n), of any size: (path, length)."""

    def write(path: str, byte: int, n: int):
        part = bytes([byte]) * BUFFER
        with Store(safe_path(root, path)).write() as f:
            for at in range(0, n, BUFFER):
                f.write(part[: n - at])
        return path, n

    return by_row(rows.select("path", "byte", "n"), write, "path string, length long")


def safe_path(root: str, relative: str) -> str:
    """A path strictly below ``root``, by name; anything that climbs out is an error."""
    parts = relative.split("/")
    if not relative or relative.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"{relative!r} isn't below the root")
    return f"{root.rstrip('/')}/{relative}"


def is_safe(relative: Column) -> Column:
    """P36 as a condition."""
    return F.coalesce((relative != "") & ~F.exists(F.split(relative, "/"), lambda p: p.isin("", ".", "..")), F.lit(False))


def back_up(rows: DataFrame, root: str) -> DataFrame:
    """Copy files (id, source) to ``root``/id/name. (id, backup, length, sha, outcome) with outcome DONE, EXISTS
    (an earlier backup is never overwritten) or FAILED, after which nothing is left behind.

    Tasks that are run again find what their first attempt wrote: equal contents count as done.
    """

    def one(key: str, source: str):
        relative = f"{key}/{source.rsplit('/', 1)[-1]}"
        to = Store(safe_path(root, relative))
        try:
            expected = Store(source).size()
            if to.size() is not None:
                n, sha = _copy(f"{root.rstrip('/')}/{relative}", None)
                same = (n, sha) == _copy(source, None)
                return key, relative, n, sha, "DONE" if same else "EXISTS"
            n, sha = _copy(source, safe_path(root, relative))
            if n == expected == to.size():
                return key, relative, n, sha, "DONE"
        except OSError:
            pass
        if to.size() is not None:
            to.remove()
        return key, relative, None, None, "FAILED"

    return by_row(rows.select("id", "source"), one, "id string, backup string, length long, sha string, outcome string")


def delete_backups(rows: DataFrame, root: str) -> DataFrame:
    """Remove backups (backup, relative to ``root``): (backup, freed, outcome). A missing file frees 0 bytes; a path
    that leaves ``root``, by name or by a link, is refused."""

    def one(relative: str | None):
        try:
            at = Store(safe_path(root, relative or ""))
        except ValueError:
            return relative, 0, "REFUSED"
        if at.linked(root):
            return relative, 0, "REFUSED"
        n = at.size()
        if n is None:
            return relative, 0, "MISSING"
        at.remove()
        return relative, n, "FREED"

    return by_row(rows.select("backup"), one, "backup string, freed long, outcome string")
