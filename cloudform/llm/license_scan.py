"""License scans by an exact set-similarity join of text blocks with notice templates. DataFrame operations only.

Words are runs of digits, letters and all non-ASCII characters, A-Z in lower case. A template of L words is compared with
blocks of 2 L words that start at every L-th word of the text, so whatever L words stand in a row, over however many
lines, are inside one block. A block matches when it holds at least `threshold` of the template's distinct words. To
find every such block without comparing all: the templates' words get one global order, rarest in the corpus first. A
template that must share `a` of its n words has a match only in blocks with one of its first n - a + 1 words (prefix);
only such blocks are formed. A block falls away with fewer than `a` of the templates' words (length), or where fewer
than `a` of them come in the global order from the block's first prefix word on (position). What is left is verified on the sets.

Besides, every place is counted where the words of a phrase stand one after the other. A null text is empty. Rows that
repeat an id are scanned one by one. A text without words has no places, no labels and a score of 0. Columns other than
doc_id and text are left away, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Sentences of public licence notices and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("all-rights-reserved", "copyright all rights reserved"),
)


def joined_words(text: F.Column) -> F.Column:
    """The words of a text with one space before, between and after them."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.translate(text, UPPER, SMALL), F.lit(" ")), BETWEEN, " ")))


def spaces(x: F.Column) -> F.Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base (labels of phrases) from their column joined."""
    joined = F.col("joined")
    ahead = "(?= (?:" + "|".join(phrases) + ") )"
    some = F.lit(False)
    for phrase in phrases:
        some = some | F.contains(joined, F.lit(f" {phrase} "))
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.contains(joined, F.lit(f" {p} ")), label) for p, label in phrases.items())), lambda x: x.isNotNull())))
    first = F.expr("substring(joined, 1, at)")
    out = docs.withColumn("some", some).withColumn("at", F.when(F.col("some"), F.regexp_instr("joined", F.lit(ahead))))
    return out.select(
        *docs.columns, F.greatest(spaces(joined) - 1, F.lit(0)).alias("n_words"),
        F.when(F.col("some"), F.regexp_count("joined", F.lit(ahead))).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("some"), spaces(first) - 1).alias("first_word"),
        F.when(F.col("some"), spaces(F.regexp_extract("joined", "(?s)^(.*)" + ahead, 1))).alias("last_word"),
        F.when(F.col("some"), labels).otherwise(F.array().cast("array<string>")).alias("base"))


def frequencies(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of some words stands in all texts; a row for each comes to the driver."""
    found = texts.select(F.explode(F.split(F.trim("joined"), " ")).alias("word")).where(F.col("word").isin(words))
    return {r.word: r["count"] for r in found.groupBy("word").count().collect()}


def longs(values) -> F.Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def matches(docs: DataFrame, templates, often: dict[str, int], threshold: float) -> DataFrame:
    """docs with found: (label, share) of each template that a block of the text in their column joined holds."""
    order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order, 1)}
    plan = []
    for label, t in templates:
        own = sorted(rank[w] for w in set(t.split()))
        least = -int(-threshold * len(own) // 1)
        plan.append((label, len(t.split()), own, least, own[: len(own) - least + 1]))
    starts = sorted({r for *_, prefix in plan for r in prefix})
    some = F.arrays_overlap("words", F.array(*(F.lit(order[r - 1]) for r in starts)))
    ranks = F.transform("words", lambda w: F.array_position(F.array(*map(F.lit, order)), w))
    spots = F.filter(F.transform("ranks", lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: F.array_contains(longs(starts), x.r))

    def share(length, own, least, prefix):
        hits = F.filter("spots", lambda x: F.array_contains(longs(prefix), x.r))
        blocks = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(F.floor(x.i / length), F.floor(x.i / length) - 1))))

        def held(j):
            inside = F.array_distinct(F.filter(F.slice("ranks", (j * length + 1).cast("int"), 2 * length), lambda r: r > 0))
            first = F.array_min(F.array_intersect(inside, longs(prefix)))
            fits = (F.size(inside) >= least) & (F.size(F.filter(inside, lambda r: r >= first)) >= least)
            return F.when(fits, F.size(F.array_intersect(inside, longs(own)))).otherwise(0)

        most = F.array_max(F.transform(F.filter(blocks, lambda j: j >= 0), held))
        return F.when(most >= least, most / len(own))

    found = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), share(*how).alias("share")) for label, *how in plan)), lambda x: x.share.isNotNull())
    out = docs.withColumn("words", F.split(F.trim("joined"), " ")).withColumn("ranks", F.when(some, ranks)).withColumn("spots", F.when(F.col("ranks").isNotNull(), spots))
    return out.withColumn("found", F.when(F.size("spots") > 0, found)).drop("words", "ranks", "spots")


def license_scan(docs: DataFrame, *, templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs(doc_id, text).

    score: 1 where a phrase stands, else the largest share of a template that a block of the text holds, if enough. The
    templates' words become literals of the plan, so templates are some hundreds at most.
    """
    texts = docs.select("doc_id", joined_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("joined"))
    often = frequencies(texts, sorted({w for _, t in templates for w in t.split()}))
    out = places(matches(texts, templates, often, threshold), phrases or PHRASES)
    more = F.coalesce(F.transform("found", lambda x: x.label), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.array_union("base", more)))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
