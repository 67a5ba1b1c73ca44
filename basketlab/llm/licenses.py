"""License scans on DataFrame functions only: exact set-similarity join of text blocks with templates.

A block is a line, or a run of words of the whole text, whatever its line breaks, so a notice may be
wrapped anywhere; a run has as many words as the template. A template is found in a block that holds
at least ``THRESHOLD`` of the template's distinct words, the words among them that tell the license
(its ``required`` words) all. The join is exact and compares few pairs:

* global order: words of the templates are counted over all documents, rare ones come first;
* prefix filter: of a template of n words of which m must be found, one of its first n - m + 1 must
  be, so blocks are looked up by these rare words alone;
* length filter: a block with fewer than m template words is out;
* positional filter: a block whose prefix word has fewer than m words from its place on, in global
  order, is out, likewise on the template's side;
* what is left is verified on full word sets.

Runs are looked up in windows of the text that overlap so far that every run stands whole in one of
them; a window passes the filters as a line does, and its runs are verified one by one.

Templates are a bounded query set: at most ``BLOCK`` words of them are joined at a time, in as many
rounds as there are. Base places are phrases whose words stand one after the other in the document,
whatever signs stand between.

Null and empty texts have no words: counts 0, no labels, score 0, first and last null. Repeated rows
are kept; rows of one id and equal text share their result. Without templates only phrases are
found; templates without a column ``required``, or null in it, require no word. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import cut
from basketlab.llm.native import NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD, words
from basketlab.session import local_table

THRESHOLD = 0.8
BLOCK = 5_000

# The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Opening notices of common licenses, as published by their stewards, and the words that tell each from others.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache"),
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution source binary"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("reserved", "All rights reserved.", "rights reserved"),
]


def templates(spark: SparkSession) -> DataFrame:
    return local_table(spark, TEMPLATES, "label string,text string,required string")


def _lower_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.lower(w))


def base_places(text: Column) -> tuple[Column, Column]:
    """Column w, the words of a text that may hold a phrase, and (start word, label) of its places."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    hint = "(?i)" + "|".join(gap.join(p.split()) for p, _ in PHRASES)
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size("w") - len(parts)), _same(parts))
        at = F.when(F.size("w") >= len(parts), at).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(at, _labelled(label)))
    empty = F.array().cast("array<struct<start:bigint,label:string>>")
    places = F.when(F.col("w").isNull(), empty).otherwise(F.concat(*found))
    return F.when(text.rlike(hint), _lower_words(text)), places


def _same(parts: list[str]):
    def check(i: Column) -> Column:
        out = F.element_at("w", i + 1) == parts[0]
        for k, part in enumerate(parts[1:], 2):
            out = out & (F.element_at("w", i + k) == part)
        return out

    return check


def _labelled(label: str):
    return lambda i: F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label"))


def _word_counts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each template word stands in all documents."""
    every = rows.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    return every.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))


def _lines(text: str, hint: str) -> Column:
    """(words, wraps) of each line that may hold an anchor."""
    kept = F.filter(F.split(text, "\n"), lambda line: line.rlike(hint))
    return F.transform(kept, lambda line: F.struct(_lower_words(line).alias("words"), F.lit(False).alias("wraps")))


def _windows(w: str, step: int, anchors: Column) -> Column:
    """(words, wraps) of windows that hold an anchor; each run of up to ``step`` words is whole in one of them."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(step))
    kept = F.filter(
        F.transform(starts, lambda at: F.slice(w, at, 2 * step - 1)), lambda x: F.arrays_overlap(x, anchors)
    )
    return F.transform(kept, lambda x: F.struct(x.alias("words"), F.lit(True).alias("wraps")))


def _best_run(window: str, words: str, run: str, required: Column) -> Column:
    """Most of the distinct ``words`` that stand in one run, with the required ones, of so many words of the window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(window) - F.col(run) + 1, F.lit(1)))
    held = F.transform(starts, lambda at: F.array_intersect(words, F.slice(window, at, F.col(run))))
    return F.array_max(F.transform(held, lambda h: F.when(_holds(h, required), F.size(h)).otherwise(0)))


def _holds(words: Column, required: Column) -> Column:
    return F.size(F.array_except(required, words)) == 0


def template_matches(
    rows: DataFrame, notices: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(doc_id, text_hash, label, share) of every block and template that meet the threshold.

    ``rows`` has doc_id, text and text_hash.
    """
    spark = rows.sparkSession
    own = F.col("required") if "required" in notices.columns else F.lit(None).cast("string")
    sets = notices.where("text is not null and label is not null").select(
        "label", _lower_words(F.col("text")).alias("words"), _lower_words(F.coalesce(own, F.lit(""))).alias("required")
    )
    # A required word that the template lacks cannot be asked for.
    asked = F.array_intersect("required", "words").alias("required")
    sets = sets.select("label", F.array_distinct("words").alias("words"), F.size("words").alias("length"), asked)
    sets = sets.where("length > 0").groupBy("label", "words", "required").agg(F.max("length").alias("length"))
    parts = max(1, math.ceil((sets.agg(F.sum(F.size("words"))).first()[0] or 0) / block))
    out = None
    for part in range(parts):
        taken = sets.where(F.pmod(F.xxhash64("label", "words"), F.lit(parts)) == part).collect()
        if not taken:
            continue
        names = sorted({w for r in taken for w in r.words})
        vocabulary = local_table(spark, [(w,) for w in names], "word string")
        counts = {r.word: r.n for r in _word_counts(rows, vocabulary).collect()}
        order = sorted(names, key=lambda w: (counts.get(w, 0), w))
        place = {w: k for k, w in enumerate(order)}
        prefixes = []
        for k, r in enumerate(taken):
            ranked = sorted(r.words, key=place.get)
            need = math.ceil(threshold * len(ranked) - 1e-9)
            for at, w in enumerate(ranked[: len(ranked) - need + 1]):
                # On the template's side the position always leaves enough words: the prefix ends there.
                prefixes.append((w, k, r.label, len(ranked), need, at, r.length))
        looked_up = sorted({p[0] for p in prefixes})
        hint = f"(?i){NOT_AFTER_WORD}(?:{'|'.join(looked_up)}){NOT_BEFORE_WORD}"
        prefix = local_table(
            spark, prefixes, "word string,template long,label string,n long,need long,at long,run int"
        )
        full = F.array(*[F.array(*[F.lit(w) for w in sorted(r.words)]) for r in taken])
        asked = F.array(*[F.array(*[F.lit(w) for w in r.required]).cast("array<string>") for r in taken])
        asked = F.element_at(asked, F.col("template").cast("int") + 1)
        ranks, anchors = F.array(*[F.lit(w) for w in order]), F.array(*[F.lit(w) for w in looked_up])
        texts = rows.where(F.col("text").rlike(hint))
        step = max(p[-1] for p in prefixes)
        blocks = texts.select("doc_id", "text_hash", "text", _lower_words(F.col("text")).alias("w")).select(
            "doc_id", "text_hash", F.inline(F.concat(_lines("text", hint), _windows("w", step, anchors)))
        )
        blocks = blocks.select(
            "doc_id", "text_hash", F.array_intersect(ranks, F.col("words")).alias("held"), F.when(F.col("wraps"), F.col("words")).alias("window")
        )
        pairs = blocks.select("*", F.posexplode("held").alias("position", "word"))
        pairs = pairs.join(F.broadcast(prefix), "word")
        pairs = pairs.where(F.size("held") >= F.col("need"))
        pairs = pairs.where(F.size("held") - F.col("position") >= F.col("need") - F.col("at"))
        pairs = pairs.withColumn(
            "common", F.array_intersect("held", F.element_at(full, F.col("template").cast("int") + 1))
        )
        pairs = pairs.where((F.size("common") >= F.col("need")) & _holds(F.col("common"), asked))
        pairs = pairs.withColumn(
            "common", F.when(F.col("window").isNull(), F.size("common")).otherwise(_best_run("window", "common", "run", asked))
        )
        found = pairs.where(F.col("common") >= F.col("need")).select(
            "doc_id", "text_hash", "label", (F.col("common") / F.col("n")).alias("share")
        )
        out = found if out is None else out.union(found)
    if out is None:
        return rows.select("doc_id", "text_hash", F.lit("").alias("label"), F.lit(0.0).alias("share")).where("false")
    return out


def scan(
    docs: DataFrame,
    notices: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: words, phrase places, labels of both kinds and a score.

    The score is 1 for a document with a phrase, else the largest share of a template found, else 0.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    w, places = base_places(F.col("text"))
    base = rows.select(
        "doc_id", "text_hash", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("n_words"), w.alias("w")
    ).select("doc_id", "text_hash", "n_words", places.alias("places"))
    notices = templates(docs.sparkSession) if notices is None else notices
    matched = template_matches(rows, notices, threshold)
    matched = cut(
        matched.groupBy("doc_id", "text_hash").agg(
            F.collect_set("label").alias("more"), F.max("share").alias("share")
        )
    ).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more", "share")
    both = base.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    labels = F.array_sort(F.array_distinct(F.col("places.label")))
    starts = F.col("places.start")
    every = F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
