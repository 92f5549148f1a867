"""Library views: pending and done items, album rollups, totals, recoverable backups.

DataFrames have no order, so where the order of items decides (last item of a path, first
journal entry), it is a column: ``ord`` for media rows, ``pos`` for journal entries.
Joins on paths are equi joins; the one on "path or URI" is two of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import media as M
from .ledger import excluded_set, restorable, saved_bytes


def single(c: Column) -> Column:
    """A whole number rounded to single precision. Catalyst would merge a cast to float with a later one
    to double, and lose the rounding; it can't see through ``greatest``."""
    return F.greatest(c.cast("float"), F.lit(-3e38).cast("float"))


def item_order() -> Column:
    """Images before videos, newest first, then by id: comparable as a struct."""
    return F.struct(F.col("is_video"), -F.col("date_added_sec"), F.col("id"))


def journal_paths(journal: DataFrame) -> DataFrame:
    """(path) of all entries."""
    return journal.select(F.explode(F.array_compact(F.array("path", "converted_path"))).alias("path")).distinct()


def recovery_reason() -> Column:
    """P19."""
    dated = F.concat(F.lit(schemas.DATES_PENDING + ":"), F.col("date_pending_reason"))
    return F.coalesce(dated, F.lit(schemas.RECOVERY_PENDING))


class Library:
    """Views of one version of the inputs.

    ``items``: media rows. ``ledger``, ``journal``: their tables. ``settings``: one row.
    ``files`` (path, length): where known, lengths of files that only the journal names.
    ``store`` (name, DataFrame -> the same rows, stored): what several views need is then derived once.
    """

    def __init__(self, items: DataFrame, ledger: DataFrame, journal: DataFrame, settings: DataFrame, files: DataFrame | None = None, store: Callable[[str, DataFrame], DataFrame] | None = None):
        self._store = store or (lambda name, df: df)
        self.items = items.withColumn("ord", item_order())
        self.ledger, self.journal, self.files = ledger, journal.withColumn("reason", recovery_reason()), files
        # One row by definition of the table.
        self.settings = settings.limit(1)
        self.excluded = self.settings.select(F.explode(excluded_set(F.col("excluded_albums"))).alias("bucket_name"))

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.excluded), "bucket_name", "left_anti")

    @cached_property
    def by_path(self) -> DataFrame:
        """The last item of each path."""
        cols = [c for c in self.items.columns if c != "data_path"]
        return self._store("by_path", self.items.groupBy("data_path").agg(F.max_by(F.struct(*cols), "ord").alias("item")))

    @cached_property
    def keys(self) -> DataFrame:
        """The few columns of items by which they meet the journal and the ledger."""
        return self._store("keys", self.items.select("key", "data_path", "uri", "ord", F.col("xmp_compress_id").isNotNull().alias("marked")))

    @cached_property
    def matches(self) -> DataFrame:
        """(key, data_path, ord, entry) of items that an entry names; the first entry wins."""
        entry = F.struct("pos", F.col("id").alias("entry_id"), "reason").alias("entry")
        paths = self.journal.select(F.explode(F.array_distinct(F.array_compact(F.array("path", "converted_path")))).alias("data_path"), entry)
        uris = self.journal.filter("converted_path IS NOT NULL").select(F.col("media_uri").alias("uri"), entry)
        cols = ["key", "data_path", "ord", "entry"]
        both = self.keys.join(paths, "data_path").select(*cols).union(self.keys.join(uris, "uri").select(*cols))
        return self._store("matches", both.groupBy("key", "data_path", "ord").agg(F.min("entry").alias("entry")))

    @cached_property
    def pending(self) -> DataFrame:
        """(data_path, reason): paths of items with an entry; the last such item of a path decides."""
        return self.matches.groupBy("data_path").agg(F.max_by("entry", "ord").alias("e")).select("data_path", F.col("e.reason").alias("reason"))

    @cached_property
    def active(self) -> DataFrame:
        """Ledger rows that still speak for their file."""
        named = journal_paths(self.journal)
        rows = self.ledger.filter(F.col("status").isin(*schemas.ACTIVE_STATUSES))
        rows = rows.join(named.select(F.col("path").alias("data_path")), "data_path", "left_anti")
        rows = rows.join(named.select(F.col("path").alias("original_path")), "original_path", "left_anti")
        rows = rows.join(self.by_path, "data_path", "left")
        i = F.col("item")
        same = (i["id"] == F.col("media_store_id")) & (i["volume_name"] == F.col("volume_name")) & (i["size"] == F.col("original_size"))
        same = same & (i["date_modified_sec"] == F.col("original_date_modified_sec")) & i["xmp_compress_id"].isNull()
        return self._store("active", rows.filter((F.col("status") != "SKIPPED") | F.coalesce(same, F.lit(False))))

    @cached_property
    def available(self) -> DataFrame:
        """Items to do, with the reason that holds now."""
        named = journal_paths(self.journal).select(F.col("path").alias("data_path"))
        held = self.pending.select("data_path").union(named).distinct()
        marked = self.keys.filter("marked").select("data_path").distinct().join(held, "data_path", "left_anti")
        done = self.active.select("data_path").union(marked).distinct()
        rows = self._shown(self.items.join(done, "data_path", "left_anti")).join(self.pending, "data_path", "left")
        rows = rows.crossJoin(F.broadcast(self.settings.select("compress_png")))  # one row
        png = F.when(~F.col("compress_png"), schemas.PNG_DISABLED)
        reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("format") == "PNG", png).otherwise(F.col("skip_reason"))
        return rows.withColumn("skip_reason", reason).drop("reason", "compress_png")

    @cached_property
    def missing(self) -> DataFrame:
        """Entries that no item answers to, as rows of their own."""
        known = self.matches.select(F.col("entry.pos").alias("pos"))
        by_path = self.journal.select("pos", F.explode(F.array_compact(F.array("path", "converted_path"))).alias("data_path")).join(self.keys.select("data_path"), "data_path", "left_semi")
        by_uri = self.journal.filter("converted_path IS NOT NULL").select("pos", F.col("media_uri").alias("uri")).join(self.keys.select("uri"), "uri", "left_semi")
        rows = self.journal.join(known.union(by_path.select("pos")).union(by_uri.select("pos")).distinct(), "pos", "left_anti")
        if self.files is not None:
            rows = rows.join(self.files.select("path", "length"), "path", "left")
        else:
            rows = rows.withColumn("length", F.lit(None).cast("long"))
        video = F.contains(F.col("media_uri"), F.lit("/video/"))
        number = F.element_at(F.split("media_uri", "/"), -1).try_cast("long")
        parts = F.split("path", "/")
        parent = F.try_element_at(parts, F.lit(-2))
        fields = {
            "key": F.concat(F.lit("journal:"), F.col("id")),
            "id": F.coalesce(number, -F.abs(F.shiftright(F.xxhash64("id"), 1)) - 1),
            "is_video": video,
            "uri": F.col("media_uri"),
            "data_path": F.col("path"),
            "volume_name": F.lit("external_primary"),
            "bucket_name": F.when(~M.is_blank(parent), parent).otherwise("PENDING_RECOVERY"),
            "display_name": F.element_at(parts, -1),
            "mime_type": F.when(video, "video/mp4").otherwise("image/jpeg"),
            "size": F.coalesce("length", F.lit(0)).cast("long"),
            "date_taken_ms": F.col("taken"),
            "date_added_sec": F.col("added"),
            "date_modified_sec": F.col("modified"),
            "width": F.lit(0),
            "height": F.lit(0),
            "kind": F.when(video, "VIDEO").otherwise("PHOTO"),
            "format": F.when(video, "MP4").otherwise("UNKNOWN"),
            "skip_reason": F.col("reason"),
            "video_codec": F.lit(None).cast("string"),
            "xmp_compress_id": F.lit(None).cast("string"),
        }
        made = rows.select(*[v.alias(k) for k, v in fields.items()])
        # They stand behind all items, in the journal's order.
        return self._shown(made).withColumn("ord", F.struct(F.lit(True).alias("is_video"), F.lit((1 << 62)).alias("col2"), F.col("id")))

    @cached_property
    def todo(self) -> DataFrame:
        """U1."""
        return self.available.drop("ord").unionByName(self.missing.drop("ord"))

    @cached_property
    def done(self) -> DataFrame:
        """Ledger rows in force, and items known by their marker only."""
        i = F.col("item")
        rows = self.active.withColumns(
            {
                "bucket_name": F.coalesce(i["bucket_name"], F.col("bucket_name")),
                "display_name": F.coalesce(i["display_name"], F.col("display_name")),
                "date_taken_ms": F.coalesce(i["date_taken_ms"], F.col("original_date_taken_ms")),
                "kind": M.parse_kind(F.col("media_kind")),
                "quality_tier": M.parse_tier(F.col("quality_tier")),
                "item_size": i["size"],
                "adopted": F.lit(False),
            }
        )
        cols = ["id", "media_store_id", "data_path", "bucket_name", "display_name", "kind", "original_size", "compressed_size", "date_taken_ms", "quality_tier", "restore_deadline_ms", "backup_rel_path", "status", "item_size", "adopted"]
        ledger = self._shown(rows.select(*cols))
        marked = self._shown(self.items.filter("xmp_compress_id IS NOT NULL"))
        marked = marked.join(ledger.select("data_path").distinct(), "data_path", "left_anti").join(self.matches.select("key"), "key", "left_anti")
        adopted = marked.select(
            F.col("xmp_compress_id").alias("id"),
            F.col("id").alias("media_store_id"),
            "data_path",
            "bucket_name",
            "display_name",
            "kind",
            F.lit(0).cast("long").alias("original_size"),
            F.col("size").alias("compressed_size"),
            "date_taken_ms",
            F.lit("BALANCED").alias("quality_tier"),
            F.lit(0).cast("long").alias("restore_deadline_ms"),
            F.lit(None).cast("string").alias("backup_rel_path"),
            F.lit("DONE").alias("status"),
            F.col("size").alias("item_size"),
            F.lit(True).alias("adopted"),
        )
        out = ledger.unionByName(adopted)
        saved = saved_bytes(F.col("status"), F.col("original_size"), F.col("compressed_size"))
        return out.withColumns({"saved": saved, "restorable": restorable(F.col("status"), F.col("backup_rel_path")), "skipped": F.col("status") == "SKIPPED"})

    def todo_albums(self) -> DataFrame:
        """A1, O2."""
        ok = F.col("skip_reason").isNull()
        held = (F.col("skip_reason") == schemas.RECOVERY_PENDING) | F.col("skip_reason").startswith(schemas.DATES_PENDING)
        zero = F.lit(0).cast("long")
        return self.todo.groupBy("bucket_name").agg(
            F.count("*").alias("count"),
            F.sum("size").alias("bytes"),
            F.count_if(ok).alias("compressible_count"),
            F.sum(F.when(ok, F.col("size")).otherwise(zero)).alias("compressible_bytes"),
            F.count_if(F.coalesce(held, F.lit(False))).alias("pending_count"),
        )

    def done_albums(self) -> DataFrame:
        """A2: before counts adopted items as 0, after includes them."""
        real = ~F.col("adopted")
        return self.done.groupBy("bucket_name").agg(
            F.count("*").alias("count"),
            F.count_if(real & ~F.col("skipped")).alias("known_before_count"),
            F.sum("original_size").alias("before"),
            F.sum("compressed_size").alias("after"),
            F.sum(F.when(real, F.greatest("saved", F.lit(0))).otherwise(0)).alias("saved"),
            F.count_if("restorable").alias("restorable_count"),
            F.bool_and("skipped").alias("all_skipped"),
        )

    def album_names(self) -> DataFrame:
        """A3: over all items, whatever the exclusions; the first position breaks ties of the count."""
        return self.items.groupBy("bucket_name").agg(F.count("*").alias("count"))

    def totals(self) -> DataFrame:
        """A4: one row. The saving is clamped once, as a sum."""
        todo = self.todo.agg(F.count("*").alias("todo_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("todo_bytes"))
        real = ~F.col("adopted")
        total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        done = self.done.agg(
            F.count("*").alias("done_count"),
            total(real, "original_size").alias("before"),
            total(real, "compressed_size").alias("after"),
            F.count_if("restorable").alias("restorable_count"),
            total(F.col("restorable"), "original_size").alias("restorable_bytes"),
        )
        both = todo.crossJoin(done).withColumn("saved", F.greatest(F.col("before") - F.col("after"), F.lit(0)))
        whole = F.col("before") + F.col("todo_bytes")
        share = (single(F.col("saved")) / single(whole)).cast("float")
        pct = F.when(whole > 0, (share * F.lit(100).cast("float")).cast("float")).otherwise(F.lit(0).cast("float"))
        return both.withColumn("pct", pct)

    def kind_bytes(self) -> DataFrame:
        """A5: what each kind takes now; all three kinds, absent ones with 0."""
        rows = self.todo.select("kind", F.col("size").alias("bytes")).union(self.done.select("kind", F.coalesce("item_size", "compressed_size")))
        kinds = self.items.sparkSession.createDataFrame([(k,) for k in schemas.KINDS], "kind string")
        sums = rows.groupBy("kind").agg(F.sum("bytes").alias("bytes"))
        return kinds.join(sums, "kind", "left").select("kind", F.coalesce("bytes", F.lit(0)).alias("bytes"))

    def kind_shares(self) -> DataFrame:
        """Whole percents, halves up; 0 without any bytes. The window spans three rows."""
        total = F.sum("bytes").over(W.partitionBy())
        exact = (single(F.col("bytes")) / single(total)).cast("float") * F.lit(100).cast("float")
        return self.kind_bytes().withColumn("percent", F.when(total > 0, F.floor(exact.cast("double") + 0.5)).otherwise(0).cast("int"))

    def backups(self) -> DataFrame:
        """The recycle list; it depends on ledger and journal alone."""
        named = journal_paths(self.journal)
        rows = self.ledger.filter(F.col("status").isin(*schemas.RECYCLE_STATUSES) & F.col("backup_rel_path").isNotNull())
        rows = rows.join(named.select(F.col("path").alias("data_path")), "data_path", "left_anti")
        return rows.join(named.select(F.col("path").alias("original_path")), "original_path", "left_anti")

    def covers(self, n: int = 4) -> DataFrame:
        """O3: the first items of each pending album."""
        w = W.partitionBy("bucket_name").orderBy(F.col("is_video"), F.desc("date_added_sec"), "id")
        return self.available.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("bucket_name", "rank", "id")

    def orphans(self, files: DataFrame) -> DataFrame:
        """Backup files (path) that neither ledger nor journal names."""
        known = self.ledger.select(F.col("backup_rel_path").alias("path")).union(self.journal.select("backup")).union(self.journal.select("safety"))
        return files.join(known.filter("path IS NOT NULL").distinct(), "path", "left_anti")


def ranked(albums: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """O2: albums by count, largest first, with their rank; ties by ``first`` (bucket_name, first),
    else by name. One row per album."""
    ties = [F.col("bucket_name")]
    if first is not None:
        albums, ties = albums.join(first, "bucket_name", "left"), [F.col("first"), F.col("bucket_name")]
    out = albums.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), *ties)))
    return out.drop("first") if first is not None else out


def shown_albums(albums: DataFrame) -> DataFrame:
    """Pending albums with something to do or to recover."""
    return albums.filter("compressible_count > 0 OR pending_count > 0")


def list_headers(albums: DataFrame) -> DataFrame:
    """One row of sums over the albums that are shown."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return shown_albums(albums).agg(F.count("*").alias("albums"), total("count").alias("items"), total("bytes").alias("bytes"), total("compressible_count").alias("compressible"))


def first_seen(items: DataFrame) -> DataFrame:
    return items.groupBy("bucket_name").agg(F.min(item_order()).alias("first"))


def todo_badge(date_pending: Column, failed: Column, supported: Column, kind: Column) -> Column:
    """P24."""
    return F.when(date_pending, "DATES").when(failed, "FAILED").when(~supported, "UNSUPPORTED").when(kind == "LIVE_PHOTO", "LIVE").when(kind == "VIDEO", "VIDEO").otherwise("NONE")


def done_badge(skipped: Column, adopted: Column, status: Column, days: Column) -> Column:
    """P25: a day late by truncation."""
    return F.when(skipped, "SKIPPED").when(adopted, "ADOPTED").when((status == "PURGED") | (days < 0), "EXPIRED").otherwise("COMPRESSED")


def recycle_state(can_restore: Column, deadline_ms: Column, now_ms: int) -> Column:
    """P26."""
    late = deadline_ms <= now_ms
    return F.when(late, "EXPIRED").when(can_restore & ~late, "AVAILABLE").otherwise("RESIDUAL")


def detail_state(skipped: Column, adopted: Column, status: Column, can_restore: Column, days: Column) -> Column:
    """P27."""
    return F.when(skipped, "SKIPPED").when(adopted, "ADOPTED").when(status == "PURGED", "PURGED").when(~can_restore, "NOT_RESTORABLE").otherwise(F.concat(F.lit("DAYS_"), days.cast("string")))
