"""Shared folder of the cluster: written tables and raw files in it.

``spark.checkpoint.dir`` names a folder that the driver and all executors see. Local
sessions that leave it unset get a folder of their own, which goes with the process; on a
cluster that is an error, as executors would write where nobody else reads.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, one made for this process, if Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            own = tempfile.mkdtemp(prefix="shoebox-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN.append("file://" + own)
        root = _OWN[0]
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between the JVM and Python. Batches of 10,000 rows, Spark's own bound, hold any number
#: of bytes, several times over: in the JVM's buffers, on the way, and in Python.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends batches of bounded size to Python.

    The bound has to hold when the result is computed, which is after the operator returned; so it stays
    in the session.
    """
    df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    return df


#: Rows that a broadcast may hold, where its rows are a few dozen bytes (some 40 MB); beyond, a join is shuffled.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, label: str, most: int = BROADCAST_ROWS, bound: int | None = None) -> DataFrame:
    """``df`` as a written table, to be broadcast if it has at most ``most`` rows. Where it can't have more than ``bound``
    and that is few enough, it needn't be written to be counted.

    Beyond that the join is a shuffle of two plain exchanges, whose large partitions adaptive
    execution can split; an aggregate between the exchange and the join would forbid it.
    """
    if bound is not None and bound <= most:
        return F.broadcast(df)
    table = materialize(df, label)
    return F.broadcast(table) if table.count() <= most else table


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each behind as many underscores as it takes for ``df`` to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def tidy() -> None:
    """Give freed memory back: a worker stays for later stages, as do the others of its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def lean(run):
    """``run`` (batches to batches) that tidies up behind each batch it has read."""

    def fed(batches):
        for b in batches:
            yield b
            del b
            tidy()

    def tidied(batches):
        yield from run(fed(batches))
        tidy()

    return tidied


def table_dir(df: DataFrame) -> str:
    """Folder of a table that :func:`materialize` returned."""
    return df._shoebox_dir


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    for made in _SCOPES:
        made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shoebox_dir = path
    return out


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that :func:`materialize` writes inside are deleted at the end, but for those put into the list."""
    made: list[str] = []
    keep: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
    kept = {table_dir(df) for df in keep}
    for path in made:
        if path not in kept:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _filesystem(uri: str):
    """(pyarrow filesystem or None for local paths, path)."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return None, u.path
    from pyarrow import fs

    # Hadoop's names of a scheme that pyarrow knows by another.
    known = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}.get(u.scheme, u.scheme)
    return fs.FileSystem.from_uri(known + uri[len(u.scheme) :])


def open_write(uri: str):
    filesystem, path = _filesystem(uri)
    if filesystem is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    return filesystem.open_output_stream(path)


def open_read(uri: str):
    """A seekable binary file."""
    filesystem, path = _filesystem(uri)
    return open(path, "rb") if filesystem is None else filesystem.open_input_file(path)


def task_tag() -> str:
    """Differs for each partition and attempt, so attempts never share a file."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return "p00000-a0" if t is None else f"p{t.partitionId():05d}-a{t.taskAttemptId()}"
