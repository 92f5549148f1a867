"""Streaming refresh of the views, and the expiry job.

The source is a directory into which ledger versions are written as Parquet, each row with
its ``version``. Each micro-batch takes the newest version it holds (a burst of changes is
one rebuild), builds the views and publishes them, unless a newer version is out already.
The commit marker follows the write, so a batch that fails is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import ledger as L
from ..sources.tables import Table

STREAM_SCHEMA = "version bigint, " + schemas.LEDGER


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """ST1."""
    return spark.readStream.schema(STREAM_SCHEMA).parquet(path)


def newest(batch: DataFrame) -> DataFrame:
    """ST2: the rows of the newest version of a batch."""
    top = batch.agg(F.max("version").alias("version"))  # one row
    return batch.join(F.broadcast(top), "version", "left_semi")


def refresh(spark: SparkSession, path: str, checkpoint: str, view: Table, build: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Keep ``view`` (with a ``version`` column) up to date with the newest ledger version; stops when
    all files are read."""

    def publish(batch: DataFrame, _: int) -> None:
        rows = newest(batch)
        version = rows.agg(F.max("version")).first()[0]
        if version is None:
            return
        shown = view.tag()
        # ST3: a result whose inputs have moved on is dropped. The version stands beside the pointer, as a view may be empty.
        if not shown or version >= int(shown):
            view.write(build(rows.drop("version")).withColumn("version", F.lit(version)), tag=str(version))

    stream = ledger_stream(spark, path)
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(table: Table, now_ms: int) -> DataFrame:
    """ST5: mark the backups of expired rows as gone; returns the ids. Run daily, and once at start."""
    rows = table.read()
    gone = L.expired(rows, now_ms).select("id")
    table.write(L.mark_backups_gone(rows, gone).drop("touched"))
    return gone


#: ST6: ids that are marked at a time.
FLUSH = 64


def flush_gone(spark: SparkSession, path: str, checkpoint: str, table: Table) -> StreamingQuery:
    """ST6: mark the backups of the ids (id) that arrive as Parquet below ``path`` as gone, a file at a time, so that what
    is done so far is kept when the run is cut short; stops when all files are read. See :func:`deal_out`."""

    def mark(batch: DataFrame, _: int) -> None:
        table.write(L.mark_backups_gone(table.read(), batch).drop("touched"))

    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(path)
    return stream.writeStream.foreachBatch(mark).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deal_out(ids: DataFrame, path: str, most: int = FLUSH) -> None:
    """Write ``ids`` in files of at most ``most`` rows."""
    ids.select("id").write.option("maxRecordsPerFile", most).mode("append").parquet(path)


class ScanMark:
    """ST4: the time of the last scan, moved only after its results are stored."""

    def __init__(self, settings: Table):
        self.settings = settings

    def run(self, scan: Callable[[], None], now_sec: int) -> None:
        scan()
        self.settings.write(L.update_settings(self.settings.read(), last_scan_sec=now_sec, cache_logic_version=schemas.CACHE_LOGIC_VERSION))
