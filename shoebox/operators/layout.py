"""Byte ranges of a file and names of new files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlaps(ranges: DataFrame, file: str = "file") -> DataFrame:
    """(file, sound): whether a file's ranges (start, size) are disjoint."""
    w = W.partitionBy(file).orderBy("start", "size")
    after = F.lead("start").over(w)
    rows = ranges.withColumn("fits", after.isNull() | (F.col("start") + F.col("size") <= after))
    return rows.groupBy(file).agg(F.bool_and("fits").alias("sound"))


def moved(ranges: DataFrame, file: str = "file") -> DataFrame:
    """Offsets after resizing; the gaps between ranges (start, size, new_size) stay."""
    before = W.partitionBy(file).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("new_size") - F.col("size")).over(before), F.lit(0))
    return ranges.withColumn("new_start", F.col("start") + shift)


def _base(name: str, ending: str) -> str:
    """As much of a name, in whole characters, as fits a file name of 255 bytes with the ending."""
    return name.encode()[: 255 - len(ending)].decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def destination(base: pd.Series, number: pd.Series) -> pd.Series:
    """the name with a number; 0 adds none."""
    out = []
    for b, n in zip(base, number, strict=True):
        ending = ".jpg" if not n else f"_{n}.jpg"
        out.append(None if b is None else _base(b, ending) + ending)
    return pd.Series(out)


def unique_destinations(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """a free JPEG name for each file of ``wanted`` (directory, name, seq), in the order of ``seq``.

    ``existing`` (directory, name) are the names in use. The n-th file of a base takes the n-th free number, which is
    n - 1 and as many more as there are numbers in use up to it. Rows of no directory or no name stay; without a name
    they have no destination.
    """
    stem = F.when(F.contains(F.col("name"), F.lit(".")), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    # Names in use that a base could take: itself, or with a number. Bases cut to 255 bytes are compared whole.
    used = existing.filter(F.col("name").endswith(".jpg")).select("directory", F.regexp_extract("name", r"^(.*?)(?:_(\d+))?\.jpg$", 1).alias("short"), F.regexp_extract("name", r"^(.*?)(?:_(\d+))?\.jpg$", 2).alias("digits"), F.regexp_replace("name", r"\.jpg$", "").alias("plain"))
    taken = used.select("directory", F.col("plain").alias("base"), F.lit(0).alias("number")).union(
        used.filter("digits <> '' AND digits NOT LIKE '0%'").select("directory", F.col("short").alias("base"), F.col("digits").try_cast("int"))
    )
    rows = taken.filter("number IS NOT NULL").distinct().withColumn("wanted", F.lit(False))
    rows = rows.unionByName(wanted.select("directory", "name", "seq", stem.alias("base"), F.lit(True).alias("wanted")), allowMissingColumns=True)
    # Numbers in use come first, so each row knows how many there are (``lower``). ``free`` counts the free numbers below
    # a number in use, or before that of a row; what of the former is up to the latter has to be added to it.
    group = W.partitionBy("directory", "base")
    in_order = group.orderBy("wanted", "number", "seq")
    rows = rows.withColumn("n", F.row_number().over(in_order)).withColumn("lower", F.count(F.when(~F.col("wanted"), 1)).over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("free", F.when(F.col("wanted"), F.col("n") - F.col("lower") - 1).otherwise(F.col("number") - F.col("n") + 1))
    more = F.count(F.when(~F.col("wanted"), 1)).over(group.orderBy("free", "wanted").rowsBetween(W.unboundedPreceding, 0))
    named = rows.withColumn("taken", F.col("free") + more).filter("wanted")
    return named.select("directory", "name", "seq", destination("base", "taken").alias("destination"))


def mean_square_error(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Adds ``mse`` of two arrays of samples and whether it is small enough (1024)."""
    total = F.aggregate(F.zip_with(left, right, lambda a, b: (a - b).cast("double") * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("mse", total / F.size(left)).withColumn("close", F.col("mse") <= 1024)
