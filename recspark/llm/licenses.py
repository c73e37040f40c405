"""Licence scans by a positional index of rare words (operator 4, native).

Each template has a mandatory key phrase. The document frequencies of all template
words are counted over the whole corpus; a phrase's rarest words (highest inverse
frequency) are its anchors. A document that holds a phrase's anchors maps each of
their places to the place where the phrase would begin; the anchors' postings are
intersected by that relative position, and what remains is compared with the phrase
word by word. A verified phrase's template is then scored by the share of its words
that stand at their places. Where the phrase is the licence's own name it gives the
label by itself and the share is only the score; a phrase that begins a licence's text
gives it with enough of that text. All of this happens inside a row: the only shuffle
is the count per template word.

Defined results: null and empty texts have no words and no labels; ties of frequency
go to the earlier word; rows that share an id are each listed; other columns are
ignored; an empty table gives an empty result; long texts are scanned whole. Main
path: DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by contract: phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Public licence sentences: label, key phrase, how many words of the text come before it, text.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", 0,
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license", 0,
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms", 0,
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "gnu general public license", 18,
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software", 0,
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "creative commons attribution noncommercial", 0,
     "creative commons attribution noncommercial 4 0 international public license"),
)
#: Labels whose key phrase is the licence's name: found, it is the licence, however the text goes on.
NAMED = ("gpl", "cc-by-nc")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2


def words_of(text: Column) -> Column:
    """Lower-case words. lower() also changes letters beyond A-Z, but never a word's
    bounds, and only the Kelvin sign becomes an ASCII letter, k, which no template holds."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _vocabulary() -> list[str]:
    return sorted({w for phrase, _ in BASE for w in phrase.split()} | {w for _, phrase, _, _ in TEMPLATES for w in phrase.split()})



def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Documents that hold each template word, over all documents; at most one number a word."""
    own = _vocabulary()
    seen = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, own)))).alias("word"))
    return {w: 0 for w in own} | {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}


def anchors(phrase: str, frequency: dict[str, int], number: int = ANCHORS) -> list[tuple[str, int]]:
    """The phrase's rarest words and their places in it."""
    places = sorted(enumerate(phrase.split()), key=lambda x: (frequency.get(x[1], 0), x[0]))
    return [(w, i) for i, w in places[:number]]


def places(words: Column, phrase: str, frequency: dict[str, int]) -> Column:
    """Where the phrase's words stand consecutively in lower-case ``words``, from 0."""
    own = phrase.split()
    marks = anchors(phrase, frequency)

    def begins(word: str, at: int) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(w == word, i - at).otherwise(-1)), lambda s: s >= 0)

    met = reduce(F.array_intersect, (begins(w, at) for w, at in marks))
    same = F.filter(met, lambda s: F.slice(words, s + 1, len(own)) == F.array(*map(F.lit, own)))
    rare = reduce(lambda a, b: a & b, (F.array_contains(words, w) for w, _ in marks))
    return F.when(rare, same).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.6, frequency: dict[str, int] | None = None,
) -> DataFrame:
    """doc_id, n_words, hits (label, start, score, base) of every row.

    ``share`` is the least share of a template's words at their places for its label,
    but for the labels of ``NAMED``."""
    frequency = document_frequencies(docs, text) if frequency is None else frequency
    worded = docs.select(F.col(key).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    # Only rows with an anchor of some phrase are looked at word by word.
    first = sorted({anchors(p, frequency, 1)[0][0] for p in [*(p for p, _ in BASE), *(t[1] for t in TEMPLATES)]})
    some = F.arrays_overlap("words", F.array(*map(F.lit, first)))
    gated = worded.select("doc_id", F.size("words").cast("long").alias("n_words"),
                          F.when(some, F.col("words")).otherwise(F.array().cast("array<string>")).alias("words"))
    words = F.col("words")

    def found(label: str, begin: Column, score: Column, base: bool) -> Column:
        return F.struct(F.lit(label).alias("label"), begin.cast("int").alias("start"), score.cast("double").alias("score"), F.lit(base).alias("base"))

    def template_hits(label: str, phrase: str, before: int, whole: str) -> Column:
        own = whole.split()

        def aligned(s: Column) -> Column:
            return F.size(F.filter(F.transform(F.array(*map(F.lit, own)), lambda w, i: w == F.get(words, s - before + i)), lambda x: x)) / len(own)

        return F.filter(F.transform(places(words, phrase, frequency), lambda s: found(label, s, aligned(s), False)),
                        lambda x: x["score"] >= (0.0 if label in NAMED else share))

    def base_hits(label: str, phrase: str) -> Column:
        return F.transform(places(words, phrase, frequency), lambda s: found(label, s, F.lit(1.0), True))

    hits = [base_hits(label, phrase) for phrase, label in BASE]
    hits += [template_hits(*t) for t in TEMPLATES]
    empty = F.array().cast("array<struct<label:string,start:int,score:double,base:boolean>>")
    return gated.select("doc_id", "n_words", F.when(F.size(words) > 0, F.concat(*hits)).otherwise(empty).alias("hits"))


def summary(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s."""
    base = F.filter("hits", lambda x: x["base"])
    starts = F.transform("base", lambda x: x["start"])
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    return scanned.withColumn("base", base).select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names("base").alias("base_labels"),
        names("hits").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def oracle(share: float = 0.6) -> str:
    """The rows in DuckDB: every start is compared, without anchors."""
    text = lambda s: "[" + ", ".join(f"'{w}'" for w in s.split()) + "]"
    hit = lambda label, phrase: (
        f"list_filter(CASE WHEN list_has_all(w, {text(phrase)}) THEN range(0, len(w)) ELSE [] END, lambda s: w[s + 1] = '{phrase.split()[0]}' AND w[s + 1 : s + {len(phrase.split())}] = {text(phrase)})")
    parts = [f"list_transform({hit(label, phrase)}, lambda s: {{'label': '{label}', 'start': s, 'score': 1.0::DOUBLE, 'base': true}})" for phrase, label in BASE]
    for label, phrase, before, whole in TEMPLATES:
        n = len(whole.split())
        share_of = f"len(list_filter(range(1, {n + 1}), lambda i: {text(whole)}[i] = w[s - {before} + i] AND s - {before} + i > 0)) / {n}.0::DOUBLE"
        parts.append(f"list_filter(list_transform({hit(label, phrase)}, lambda s: {{'label': '{label}', 'start': s, 'score': {share_of}, 'base': false}}), lambda x: x.score >= {0.0 if label in NAMED else share})")
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    names = lambda h: f"array_to_string(list_sort(list_distinct(list_transform({h}, lambda x: x.label))), ',')"
    return rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), h AS (SELECT doc_id, len(w) AS n_words, {joined} AS hits FROM d
), b AS (SELECT *, list_filter(hits, lambda x: x.base) AS base FROM h)
SELECT doc_id, n_words::BIGINT AS n_words, len(base)::BIGINT AS n_base,
  list_min(list_transform(base, lambda x: x.start))::BIGINT AS first_word, list_max(list_transform(base, lambda x: x.start))::BIGINT AS last_word,
  coalesce({names('base')}, '') AS base_labels, coalesce({names('hits')}, '') AS labels,
  coalesce(list_max(list_transform(hits, lambda x: x.score)), 0.0::DOUBLE) AS score
FROM b"""
