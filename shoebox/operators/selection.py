"""Filters and selections of the pending and done lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TODO_KINDS = {"photo": "PHOTO", "live": "LIVE_PHOTO", "video": "VIDEO"}


def todo_filter(todo: DataFrame, name: str) -> DataFrame:
    """P13; an unknown name keeps all."""
    if name == "skip":
        return todo.filter("skip_reason IS NOT NULL")
    if name in TODO_KINDS:
        return todo.filter((F.col("skip_reason").isNull()) & (F.col("kind") == TODO_KINDS[name]))
    return todo


def done_filter(done: DataFrame, name: str) -> DataFrame:
    """P14."""
    conditions = {"restorable": "restorable", "expired": "NOT restorable AND NOT skipped", "skipped": "skipped"}
    return done.filter(conditions[name]) if name in conditions else done


def pick_albums(rows: DataFrame, albums: DataFrame, actionable: Column) -> DataFrame:
    """Level 1, the actionable rows of the picked albums (bucket_name)."""
    return rows.filter(actionable).join(albums.select("bucket_name").distinct(), "bucket_name", "left_semi")


def pick_items(rows: DataFrame, album: str, ids: DataFrame, actionable: Column, id_col: str = "id") -> DataFrame:
    """Level 2, the actionable rows of one album whose id is picked."""
    picked = ids.select(F.col("id").alias("__id")).distinct()
    return rows.filter((F.col("bucket_name") == album) & actionable).join(picked, F.col(id_col) == F.col("__id"), "left_semi")


def summary(rows: DataFrame, size: str, after: str | None = None) -> DataFrame:
    """One row; the saving isn't negative."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kinds = [F.count_if(F.col("kind") == k).alias(a) for k, a in (("PHOTO", "photos"), ("LIVE_PHOTO", "lives"), ("VIDEO", "videos"))]
    out = rows.agg(
        F.count("*").alias("count"), total(size).alias("bytes"), (total(after) if after else F.lit(0).cast("long")).alias("after_bytes"), *kinds, F.array_sort(F.collect_set("bucket_name")).alias("albums")
    )
    return out.withColumn("saved_bytes", F.greatest(F.col("bytes") - F.col("after_bytes"), F.lit(0)))


def toggle(picked: Column, name: Column) -> Column:
    """U4: the set with one element more or less; sorted."""
    return F.array_sort(F.when(F.array_contains(picked, name), F.array_remove(picked, name)).otherwise(F.array_append(picked, name)))


def select_all(picked: Column, shown: Column) -> Column:
    """U4: all of ``shown`` picked already: take them out; else add them."""
    every = (F.size(shown) > 0) & (F.size(F.array_except(shown, picked)) == 0)
    return F.array_sort(F.when(every, F.array_except(picked, shown)).otherwise(F.array_union(picked, shown)))


def all_selected(shown: Column, picked: Column) -> Column:
    """Of nothing, false."""
    return (F.size(shown) > 0) & F.forall(shown, lambda x: F.array_contains(picked, x))


def quantifiers(rows: DataFrame, by: str, condition: Column) -> DataFrame:
    """A16 of groups: (by, every, some); a group has a row at least, so that of nothing there is none."""
    return rows.groupBy(by).agg(F.bool_and(condition).alias("every"), F.bool_or(condition).alias("some"))


def tier_of(kind: Column, role: Column, settings: dict[str, str]) -> Column:
    """The item's tier by kind; a live photo's own video has a tier of its own."""
    video = F.when(kind == "VIDEO", settings["video_tier"]).otherwise(settings["live_video_tier"])
    image = F.when(kind == "LIVE_PHOTO", settings["live_tier"]).when(kind == "VIDEO", settings["video_tier"]).otherwise(settings["photo_tier"])
    return F.when(role == "video", video).otherwise(image)


def parallelism(batch: DataFrame, fast: bool, free_bytes: int | None, cores: int, by: str | None = None) -> DataFrame:
    """One at a time for a batch with a large or unmeasured PNG or HEIC; else by free memory. ``by`` tells batches apart."""
    area = F.col("width").cast("long") * F.col("height")
    unknown = (F.col("width") <= 0) | (F.col("height") <= 0)
    large = ((F.col("format") == "PNG") & (unknown | (area > 16_000_000))) | ((F.col("format") == "HEIC") & (unknown | (area > 20_000_000)))
    by_memory = 2 if free_bytes is None else min(cores, 3 if free_bytes > 2 << 30 else 2 if free_bytes > 1 << 30 else 1)
    n = F.when(F.lit(not fast) | F.coalesce(F.bool_or(large), F.lit(False)), 1).otherwise(by_memory)
    return batch.groupBy(*[by] if by else []).agg(n.cast("int").alias("parallelism"))


def message_lines(text: Column) -> Column:
    """Trimmed, distinct lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(lines), "\n")
