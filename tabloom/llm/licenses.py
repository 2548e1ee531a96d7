"""License scan by diagonal voting.

The rolling word pairs of every document are joined to the places where the templates hold
the same pair. A match votes for the diagonal (place in the text minus place in the template);
votes on one diagonal are words that run in step with the template. Diagonals that lie within a
few words of each other are merged, so that an inserted or a missing word does not break a
match, and the span is verified by the share of the template's pairs that it covers and by its
last pair.

Base phrases are templates too, of which every pair must vote on one diagonal: the place where
the phrase's words stand consecutively. Pairs are compared by 64-bit hash.

Templates are a parameter of the caller and not data, so they are small and are broadcast. The
texts are read once, and only pairs that occur in a template leave the scan.

Defined results: a null or empty text has no words, no places and empty labels; rows are told
apart by where they stand and not by their id, so null and repeated ids give a row each; an
empty table gives no rows. Only the named id and text columns of the input are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import as_long, once, table, text_or_empty

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words of well-known licenses and notices.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
#: Diagonals this close are one match; the share of a template's pairs that makes a label.
NEAR, COVER = 3, 0.8
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAKS), lambda x: x != "")


def _pairs(words: Column) -> Column:
    return once(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1])))


def template_places(spark: SparkSession, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """``(hash, template, label, is_base, pairs, offset)``; templates have 2 to 63 words."""
    rows = [(n, t, label, is_base) for n, (t, label, is_base) in enumerate([(t, x, True) for t, x in base.items()] + [(t, x, False) for t, x in templates.items()])]
    for _, t, _, _ in rows:
        if not 2 <= len(t.split()) <= 63:
            raise ValueError(f"a template has 2 to 63 words: {t}")
    listed = spark.createDataFrame(rows, "template int, words string, label string, is_base boolean")
    hashed = listed.withColumn("hashes", _pairs(F.split("words", " ")))
    return hashed.select("template", "label", "is_base", F.size("hashes").alias("pairs"), F.posexplode("hashes").alias("offset", "hash"))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents ``(row, key, n_words)`` with every verified span ``(label, is_base, first, cover)`` in ``spans``."""
    spark = docs.sparkSession
    # the last element of each row's array stands for the row itself: a text without any match stays
    grams = once(words_of(text_or_empty(text)), lambda w: F.concat(
        F.transform(_pairs(w), lambda h: F.struct(h.alias("hash"), F.lit(None).cast("int").alias("n"))),
        F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.size(w).alias("n"))),
    ))
    rolled = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), grams.alias("grams")).select(
        "row", "key", F.posexplode("grams").alias("place", "g")
    ).select("row", "key", "place", "g.hash", "g.n")
    places = F.broadcast(template_places(spark, base, templates))
    hits = rolled.join(places, "hash", "left").filter(F.col("n").isNotNull() | F.col("template").isNotNull())
    votes = hits.groupBy("row", "key", "template", (F.col("place") - F.col("offset")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("pairs").alias("pairs"),
        F.bit_or(F.expr("shiftleft(1L, coalesce(offset, 0))")).alias("votes"), F.min("place").alias("place"), F.max("n").alias("n"),
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    # base phrases are never merged: their words stand consecutively
    starts = F.when(F.col("is_base") | gap.isNull() | (gap > NEAR), 1).otherwise(0)
    merged = (
        votes.withColumn("new", starts).withColumn("span", F.sum("new").over(by_diagonal))
        .groupBy("row", "key", "template", "span")
        .agg(
            F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("pairs").alias("pairs"),
            F.bit_or("votes").alias("votes"), F.min("place").alias("first"), F.max("n").alias("n"),
        )
        .withColumn("cover", F.bit_count("votes") / F.col("pairs"))
    )
    # versions stand at the end of a template: a span that does not reach it is another license's
    ends = F.expr("votes & shiftleft(1L, pairs - 1)") != 0
    good = F.col("template").isNotNull() & F.when(F.col("is_base"), F.col("cover") == 1).otherwise((F.col("cover") >= COVER) & ends)
    span = F.struct("label", "is_base", F.col("first").cast("long").alias("first"), "cover")
    return merged.groupBy("row", "key").agg(
        F.max("n").cast("long").alias("n_words"),
        F.collect_list(F.when(good, span)).alias("spans"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("best"),
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select(as_long("doc_id").alias("doc_id"), "text"))
    base = F.filter("spans", lambda s: s["is_base"])
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        F.col("key").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        _joined(F.transform("spans", lambda s: s["label"])).alias("labels"),
        F.round("best", 6).alias("score"),
    )
