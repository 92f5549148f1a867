"""License scan by diagonal voting.

All rolling word k-grams of all texts are joined to the positions of the templates'
k-grams. A hit at word p of a text and word t of a template votes for diagonal
p - t. Votes are summed by diagonal, neighbouring diagonals (a few words inserted
or left out) are merged, and the merged spans are verified: which template words
they cover, in how long a stretch of text.

Phrases are templates whose every word must stand on a single diagonal; they give
the base labels. Longer notices are templates that need only be covered largely.

Defined cases: a null or empty text has no words and no labels; a null ``doc_id``
is kept as null; repeated rows are scanned each for itself; places of a phrase may
overlap and count each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import bounded_batches, lean
from .textscan import ALNUM, U64, Words, chunks, mix, text_bytes

K = 3
CHUNK = 1 << 21
#: Diagonals so far apart at most belong to one span.
DRIFT = 3
#: Share of a notice's k-grams that must be covered for its label.
LEAST_COVER = 0.8
# Phrases of the base labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Notices of public licenses (their standard short forms).
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-3": "gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
}


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all k-grams, where each document's begin, words per document)."""
    words = Words(data, offsets, ALNUM)
    n = np.maximum(words.counts - K + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], n)
    acc = np.zeros(len(at), np.uint64)
    for i in range(K):
        acc = mix(acc * U64(0xD6E8FEB86659FD93) + words.hashes[at + i])
    return acc.view(np.int64), first, words.counts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document. A leading entry of the k-grams stands for the document itself."""
    for b in batches:
        data, offsets = text_bytes(b.column(2))
        for lo, hi in chunks(offsets, CHUNK):
            part = offsets[lo : hi + 1]
            hashes, first, n_words = grams(data[part[0] : part[-1]], part - part[0])
            values = np.insert(hashes, first[:-1], 0)
            ends = (first + np.arange(len(first))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n_words, pa.int64()), lists], names=["row", "doc_id", "n_words", "grams"])


def templates(spark: SparkSession) -> DataFrame:
    """(gram, template, t, phrase): positions of the templates' k-grams. A table of fixed size."""
    rows = []
    names = [(x, True, label) for label, x in PHRASES.items()] + [(x, False, label) for label, x in NOTICES.items()]
    column = pa.array([x for x, _, _ in names])
    hashes, first, _ = grams(*text_bytes(column))
    for i in range(len(names)):
        rows += [(int(h), i, t) for t, h in enumerate(hashes[first[i] : first[i + 1]])]
    return spark.createDataFrame(rows, "gram long, template int, t int")


def template_facts(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, n_grams) of each template."""
    rows = [(label, True, len(x.split()) - K + 1) for label, x in PHRASES.items()] + [(label, False, len(x.split()) - K + 1) for label, x in NOTICES.items()]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "template int, label string, phrase boolean, n_grams int")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(votes, rows). Votes: diagonals per row and template; rows ride along as template -1."""
    spark = docs.sparkSession
    keyed = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = keyed.mapInArrow(lean(_scan), "row long, doc_id long, n_words long, grams array<long>")
    every = scanned.select("row", "doc_id", "n_words", F.posexplode("grams").alias("pos", "gram"))
    hits = every.join(F.broadcast(templates(spark)), "gram", "left").filter("pos = 0 OR template IS NOT NULL")
    # The leading entry is the document; its own value never is a hit.
    hits = hits.withColumn("template", F.when(F.col("pos") == 0, F.lit(-1)).otherwise(F.col("template")))
    hits = hits.withColumn("diagonal", F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.col("pos") - 1 - F.col("t")))
    return hits.groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(
        F.collect_set("t").alias("covered"), F.min(F.col("pos") - 1).alias("from_word"), F.max(F.col("pos") - 1).alias("to_word")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Result per document: n_words, places of phrases, labels and score, and the verified spans."""
    spark = docs.sparkSession
    votes = spans(docs, id_col, text_col).join(F.broadcast(template_facts(spark)), "template", "left")
    # Phrases: the diagonal itself must hold every k-gram. Notices: diagonals close by are one span.
    own = W.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("diagonal") - F.lag("diagonal").over(own) > DRIFT
    alone = F.coalesce(F.col("phrase"), F.lit(True))
    votes = votes.withColumn("span", F.when(alone, F.col("diagonal")).otherwise(F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(own)))
    merged = votes.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "n_grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"),
        F.min("diagonal").alias("diagonal"),
        F.min("from_word").alias("from_word"),
        (F.max("to_word") + K - 1).alias("to_word"),
    )
    cover = F.col("n_covered") / F.col("n_grams")
    # Verification: covered share of the template, and a span not much longer than it.
    tight = F.col("to_word") - F.col("from_word") + 1 <= (F.col("n_grams") + K - 1) * 1.5 + DRIFT
    verified = F.when(F.col("phrase"), F.col("n_covered") == F.col("n_grams")).otherwise((cover >= LEAST_COVER) & tight)
    merged = merged.withColumn("cover", F.when(F.col("template") >= 0, cover)).withColumn("ok", F.coalesce(verified, F.lit(False)))
    place = F.when(F.col("ok") & F.col("phrase"), F.col("diagonal").cast("long"))
    label = lambda when: F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(when, F.col("label"))))), ",")
    span = F.when(F.col("ok"), F.struct(F.col("from_word").cast("long").alias("from_word"), F.col("to_word").cast("long").alias("to_word"), "label", "cover"))
    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        label(F.col("ok") & F.col("phrase")).alias("base_labels"),
        label(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("cover"))), F.max("cover") * 0.5, F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    ).drop("row")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
