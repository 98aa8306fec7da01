"""License scans by diagonal voting.

Every run of three words of a document is joined by hash with the runs of the
license templates, and compared word by word. A hit at word ``at`` of the document
and ``place`` of the template votes for the diagonal ``at - place``: a copy of the
template puts all its votes on one diagonal. A word put in or left out moves the
rest to a neighbouring diagonal, so neighbours are merged: from each diagonal on,
those that follow at small steps and lie at most the template's length away. The
merged votes are verified by the share of the template that they cover. A name that
is repeated many times makes a long chain of diagonals, which is thus cut at every
one of them and hides no notice.

The templates are fixed text of this module, a few hundred runs; they are the only
thing that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprobe.llm.ngrams import find_windows, hashed_targets, plain_words

RUN = 3
NEAR = 3
COVER = 0.6

# Phrases of the base scan, and the notices of public licenses.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited"),
)


def template_runs(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template``, ``label``, ``place``, ``runs`` (of the template), ``target`` and ``hash``."""
    texts = spark.createDataFrame([(n, *x) for n, x in enumerate(templates)], "template int, label string, text string")
    words = texts.select("template", "label", plain_words(F.col("text")).alias("words"))
    runs = F.size("words") - (RUN - 1)
    rows = words.select("template", "label", "words", runs.alias("runs"), F.explode(F.sequence(F.lit(0), runs - 1)).alias("place"))
    target = F.slice("words", F.col("place") + 1, F.lit(RUN))
    return rows.select("template", "label", "runs", "place", target.alias("target"), hashed_targets(target).alias("hash"))


def license_spans(docs: DataFrame, key: list[str], templates=TEMPLATES) -> DataFrame:
    """Verified spans: ``key``, ``label``, ``first_word``, ``last_word``, ``score``. ``docs`` has ``key`` and ``words``.

    A run that stands in several templates votes for each of them, and one that is
    repeated in the document votes for each of its diagonals; no vote is dropped.
    A diagonal that covers as much alone as with its neighbours is a span by itself.
    Spans of one notice may overlap. Documents without words have none.
    """
    found = find_windows(docs, key, template_runs(docs.sparkSession, templates), [RUN])
    votes = found.select(*key, "template", "label", "runs", "place", "at", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = votes.groupBy(*key, "template", "label", "runs", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    banded = diagonals.withColumn("far", far.cast("int")).withColumn("band", F.sum("far").over(order))
    longest = max(len(text) for _, text in templates) // 2 + 1  # words, at most
    ahead = F.collect_list(F.struct("band", "diagonal", "places", "low", "high")).over(order.rangeBetween(0, longest + NEAR))
    mates = F.filter("ahead", lambda x: (x["band"] == F.col("band")) & (x["diagonal"] <= F.col("diagonal") + F.col("runs") + NEAR))
    merged = banded.withColumn("ahead", ahead).withColumn("mates", mates)
    covered = F.size(F.array_distinct(F.flatten(F.transform("mates", lambda x: x["places"]))))
    alone = F.size("places") >= covered
    spans = merged.select(
        *key,
        "label",
        F.when(alone, F.col("low")).otherwise(F.array_min(F.transform("mates", lambda x: x["low"]))).alias("first_word"),
        (F.when(alone, F.col("high")).otherwise(F.array_max(F.transform("mates", lambda x: x["high"]))) + RUN - 1).alias("last_word"),
        (covered / F.col("runs")).alias("score"),
    )
    return spans.where(F.col("score") >= COVER)


def _phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the phrase; looked for word by word only where its text occurs."""
    parts = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def starts(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), starts)
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: words, base places and labels, all labels, the best score.

    ``score`` is the largest covered share of a template; a base phrase is covered
    wholly. Null and empty texts have no words, no labels and score 0. Repeated rows
    get equal results; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("digest"), plain_words(F.col("text")).alias("words"))
    spans = license_spans(rows, ["doc_id", "digest"], templates)
    extra = spans.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    places = [_phrase_places(F.col("words"), p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)]
    base = rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), *places)
    joined = base.join(extra, base["doc_id"].eqNullSafe(extra["doc_id"]) & (base["digest"] == extra["digest"]), "left")
    names = [F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]
    base_labels = F.filter(F.array(*names), F.isnotnull)
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    score = F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        base["doc_id"],
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.least(score, F.lit(1.0)).alias("score"),
    )
