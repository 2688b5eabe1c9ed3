"""Licences in whole texts: fixed phrases, and an exact set-similarity join with templates.

For a template of n words a text block is a window of 2 n words, whatever the line breaks,
as a set of words; windows start at every n words, so each notice lies whole in one of
them. Template words, also those of a block, are ordered by how many documents have them,
rarest first. A block that holds the asked share of a template must hold one of the
template's first words (prefix), enough words at all (length), and enough words of both
from the shared word on (position). Survivors are counted exactly. Texts are read twice:
for frequencies, then for blocks.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let
from riskloom.session import staged

# Phrases of the base labels, and notices as templates of the method.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache",
           ("general", "public", "license"): "gpl"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]
THRESHOLD = 0.8
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, BREAK), "")


def phrase_places(words: Column) -> Column:
    """Array of (at, label) where the words of a phrase stand one after the other."""
    def label(i):
        found = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            same = F.lit(True)
            for k, word in enumerate(phrase):
                same = same & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            found = F.when(same, F.lit(name)).otherwise(found)
        return found

    places = F.transform(words, lambda w, i: F.when(
        w.isin(*sorted({p[0] for p in PHRASES})), F.struct(i.cast("bigint").alias("at"), label(i).alias("label"))))
    return F.filter(places, lambda p: p["label"].isNotNull())


def ordered_templates(docs: DataFrame, templates=TEMPLATES) -> tuple[list[tuple[int, str, list[str]]], list[str]]:
    """Templates (length, label, distinct words) and all their words, rarest first by document frequency.

    What reaches the driver is one count for each template word.
    """
    universe = sorted({w for _, text in templates for w in text.split()})
    have = F.array_intersect(words_of(lowered(F.col("text"))), F.array(*map(F.lit, universe)))
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(have).alias("w")).groupBy("w").agg(
        F.count("*").alias("n")).collect()}
    order = sorted(universe, key=lambda w: (counts.get(w, 0), w))
    return [(len(text.split()), label, [w for w in order if w in set(text.split())]) for label, text in templates], order


def needed(words: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def blocks_of(low: Column, templates: list, order: list[str], threshold: float) -> Column:
    """Structs (length, block) of the windows that may hold enough of a template of that length.

    A block is a set of template words, rarest first. Windows of twice a template's
    length start at every such length; only texts with enough of a template's words have any.
    """
    known = F.transform(words_of(low), lambda w: F.when(w.isin(order), w))
    ranked = F.array(*map(F.lit, order))
    nothing = F.array().cast("array<struct<length:int,block:array<string>>>")

    def of_length(found, whole, length):
        own = [words for n, _, words in templates if n == length]
        some = F.lit(False)
        for words in own:
            some = some | (F.size(F.array_intersect(whole, F.array(*map(F.lit, words)))) >= needed(words, threshold))
        least = min(needed(words, threshold) for words in own)
        prefix = F.array(*map(F.lit, sorted({w for words in own for w in words[: len(words) - needed(words, threshold) + 1]})))
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(length))
        sets = F.transform(starts, lambda i: F.array_intersect(ranked, F.slice(found, i + 1, 2 * length)))
        fit = F.filter(sets, lambda block: (F.size(block) >= least) & F.arrays_overlap(block, prefix))
        return F.when(some, F.transform(fit, lambda block: F.struct(F.lit(length).alias("length"), block.alias("block")))) \
            .otherwise(nothing)

    def windows(found):
        return let(F.array_intersect(ranked, found), lambda whole: F.concat(
            *(of_length(found, whole, n) for n in sorted({n for n, _, _ in templates}))))

    return F.array_distinct(let(known, windows))


def matches(blocks: DataFrame, templates: list, threshold: float) -> DataFrame:
    """(row, label, share) of every (row, length, block) and template of that length with enough in common."""
    spark = blocks.sparkSession
    index = spark.createDataFrame(
        [(word, length, place, label, words, len(words), needed(words, threshold))
         for length, label, words in templates
         for place, word in enumerate(words[: len(words) - needed(words, threshold) + 1])],
        "word string, length int, place int, label string, words array<string>, m int, need int")
    probe = blocks.select("row", "length", "block", F.posexplode("block").alias("at", "word"))
    # the index holds the prefix words of the listed templates: bounded by TEMPLATES
    found = probe.join(F.broadcast(index), ["word", "length"]) \
        .filter(F.least(F.size("block") - F.col("at"), F.col("m") - F.col("place")) >= F.col("need"))
    met = found.withColumn("n", F.size(F.array_intersect("block", "words"))).filter("n >= need")
    return met.select("row", "label", (F.col("n") / F.col("m")).alias("share"))


def scan_documents(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    The score is 1 with a base phrase, else the largest share of a template that a block
    holds, else 0. Null texts count as empty; repeated rows stay and get equal results;
    only doc_id and text are read. An empty table gives an empty result.
    """
    ordered, universe = ordered_templates(docs, templates)
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("text")) \
        .select("doc_id", "text", lowered(F.col("text")).alias("low"))
    empty = F.array().cast("array<struct<at:bigint,label:string>>")
    places = F.when(F.col("low").contains("license"), let(words_of(F.col("low")), phrase_places)).otherwise(empty)
    read = staged(rows.select(
        "doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("row"),
        F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("n_words"), places.alias("places"),
        blocks_of(F.col("low"), ordered, universe, threshold).alias("blocks")), "licences")
    found = matches(read.select("row", F.inline("blocks")).distinct(), ordered, threshold) \
        .groupBy(F.col("row").alias("_row")).agg(
            F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))
    joined = read.join(found, read.row == found._row, "left")
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    starts = F.transform("places", lambda p: p["at"])
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>")))), ",")
        .alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))
