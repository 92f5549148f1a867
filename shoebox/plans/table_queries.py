"""Queries that write tables or run streams, and those over byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import layout
from ..operators import ledger as L
from ..sources.driver import NOW_MS, Driver
from ..sources.tables import Table
from ..streaming import refresh
from .registry import MEDIA_COLUMNS, query


@query("k1_replace_all", f"SELECT {MEDIA_COLUMNS} FROM media")
def _(d: Driver) -> DataFrame:
    table = Table(d.spark, d.workspace(), schemas.MEDIA)
    table.write(d.cache())
    table.write(d.media())
    return table.read()


@query("st1_stream_refresh", "SELECT status, count(*) AS n, 2 AS version FROM ledger GROUP BY status")
def _(d: Driver) -> DataFrame:
    at, rows = d.workspace(), d.ledger()
    view = Table(d.spark, f"{at}/view", "status string, n long, version long")
    for version, part in ((1, rows.filter("media_store_id % 2 = 0")), (2, rows)):
        part.withColumn("version", F.lit(version).cast("long")).select("version", *rows.columns).write.mode("append").parquet(f"{at}/in")
        refresh.refresh(d.spark, f"{at}/in", f"{at}/checkpoint", view, lambda r: r.groupBy("status").agg(F.count("*").alias("n"))).awaitTermination()
    return view.read()


@query(
    "st5_expiry_job",
    f"SELECT id, CASE WHEN late THEN 'PURGED' ELSE status END AS status, CASE WHEN NOT late THEN backup_rel_path END AS backup_rel_path FROM (SELECT *, status = 'DONE' AND backup_rel_path IS NOT NULL AND restore_deadline_ms < {NOW_MS} AS late FROM ledger)",
)
def _(d: Driver) -> DataFrame:
    table = Table(d.spark, d.workspace(), schemas.LEDGER, "ledger")
    table.write(d.ledger())
    refresh.expire(table, NOW_MS)
    return table.read().select("id", "status", "backup_rel_path")


@query(
    "st6_flush",
    "SELECT id, CASE WHEN hit AND status = 'DONE' THEN 'PURGED' ELSE status END AS status, CASE WHEN NOT hit THEN backup_rel_path END AS backup_rel_path FROM (SELECT *, media_store_id % 5 = 1 AND backup_rel_path IS NOT NULL AS hit FROM ledger)",
)
def _(d: Driver) -> DataFrame:
    table, at = Table(d.spark, d.workspace(), schemas.LEDGER, "ledger"), d.workspace()
    table.write(d.ledger())
    ids = d.ledger().filter("media_store_id % 5 = 1").select("id")
    # Four files: on a cluster a flush holds far more ids than on a phone.
    refresh.deal_out(ids.coalesce(1), f"{at}/ids", most=-(-ids.count() // 4))
    refresh.flush_gone(d.spark, f"{at}/ids", f"{at}/checkpoint", table).awaitTermination()
    return table.read().select("id", "status", "backup_rel_path")


@query("st4_scan_mark", "SELECT 1 AS id, 77 AS last_scan_sec, 4 AS cache_logic_version, true AS compress_png")
def _(d: Driver) -> DataFrame:
    table = Table(d.spark, d.workspace(), schemas.SETTINGS, "settings")
    table.write(L.insert_if_missing(table.read(), d.settings()))
    refresh.ScanMark(table).run(lambda: None, 77)
    return table.read().select("id", "last_scan_sec", "cache_logic_version", "compress_png")


def ranges(d: Driver) -> DataFrame:
    k = F.col("o_orderkey")
    return d.table("orders").select(F.floor(k / 10).alias("file"), ((k % 10) * 100).alias("start"), (F.when(k % 70 == 3, 101).otherwise(90 + k % 7)).cast("long").alias("size"), (k % 50).alias("new_size"))


_RANGES = ", r AS (SELECT o_orderkey // 10 AS file, (o_orderkey % 10) * 100 AS start, CASE WHEN o_orderkey % 70 = 3 THEN 101 ELSE 90 + o_orderkey % 7 END AS size, o_orderkey % 50 AS new_size FROM orders) "
query("w1_w2_overlaps", _RANGES + "SELECT file, coalesce(max(CASE WHEN size > 100 THEN 1 ELSE 0 END) = 0, true) AS sound FROM r GROUP BY file")(lambda d: layout.overlaps(ranges(d)))
query("w3_new_offsets", _RANGES + "SELECT file, start, start + coalesce(sum(new_size - size) OVER (PARTITION BY file ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM r")(
    lambda d: layout.moved(ranges(d)).select("file", "start", "new_start")
)
query("a17_mean_square_error", "SELECT vec_id, (label * label)::DOUBLE AS mse, true AS close FROM embeddings")(
    lambda d: layout.mean_square_error(
        d.table("embeddings").select("vec_id", F.sequence(F.lit(1), F.lit(64)).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x + F.col("label")).alias("b")), "a", "b"
    ).select("vec_id", "mse", "close")
)
