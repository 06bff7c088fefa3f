"""License scans: phrases word by word, and templates by an exact set-similarity join with text blocks.

A block is a sentence of a paragraph, over the line ends inside it; paragraphs end at blank lines. A template is found in a block that holds at least the
threshold's share of its distinct words. Words are ordered by how many documents have them, rarest
first. A block that meets the threshold has one of the first `size - need + 1` words of the
template (prefix filter), at least `need` words of any template (length filter), and enough words
left behind the first one they share (positional filter); what passes is counted exactly. Only
words of templates take part, so the ordering and the index are as large as the templates.

Defined cases: a null text counts as empty; a document without words has no places and score 0;
repeated rows get the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.tables import prefixed, stored

#: Characters between words, before and after A-Z became lower case.
GAP_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ends of blocks: blank lines and ends of sentences. A line end alone is none, as notices are wrapped.
BLOCK_END = r"\n[\x20\x09\x0D]*\n|[.!?;][\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-notice", "licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "no part of this publication may be reproduced without the prior written permission of the publisher"),
    ("reserved-notice", "copyright holder all rights reserved"),
)


@dataclass(frozen=True)
class Scan:
    """Phrases and templates are given in lower case, words apart by one space."""

    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    threshold: float = 0.9


def needed(words: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * words - 1e-9))


def _has(padded: Column, words: str) -> Column:
    return F.contains(padded, F.lit(" " + words.replace(" ", "  ") + " "))


def _places(words: str, phrase: str, size: Column) -> Column:
    parts = phrase.split(" ")
    at = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(parts)))
    starts = F.when(size >= len(parts), F.sequence(F.lit(0), size - len(parts)))
    return F.coalesce(F.filter(starts, at), F.array().cast("array<int>"))


def _join_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def phrase_counts(docs: DataFrame, scan: Scan) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word and the base labels as an array."""
    # Two spaces between words, so that each has spaces of its own beside it.
    df = docs.select("doc_id", "key", F.trim(F.regexp_replace("text", GAP_RAW, "  ")).alias("spaced"))
    n_words = F.when(F.col("spaced") == "", 0).otherwise(
        F.expr("(length(spaced) - length(replace(spaced, '  ', ''))) div 2 + 1")
    )
    df = df.select(
        "doc_id", "key", "spaced", n_words.cast("bigint").alias("n_words"),
        F.concat(F.lit(" "), F.lower("spaced"), F.lit(" ")).alias("padded"),
    )
    any_phrase = reduce(lambda a, b: a | b, (_has(F.col("padded"), p) for p in scan.phrases), F.lit(False))
    # Positions are looked up only where a phrase occurs.
    df = df.select(
        "doc_id", "key", "n_words",
        F.when(any_phrase, F.split(F.translate("spaced", UPPER, LOWER), "  ")).alias("words"),
    )
    df = df.select(
        "doc_id", "key", "n_words",
        *(F.when(F.col("words").isNotNull(), _places("words", p, F.size("words"))).alias(f"p{k}") for k, p in enumerate(scan.phrases)),
    )
    found = [F.coalesce(F.col(f"p{k}"), F.array().cast("array<int>")) for k in range(len(scan.phrases))]
    everywhere = F.concat(F.array().cast("array<int>"), *found)
    labels = [F.when(F.size(at) > 0, F.lit(label)) for at, label in zip(found, scan.phrases.values(), strict=True)]
    return df.select(
        "doc_id", "key", "n_words",
        F.size(everywhere).cast("bigint").alias("n_base"),
        F.array_min(everywhere).cast("bigint").alias("first_word"),
        F.array_max(everywhere).cast("bigint").alias("last_word"),
        F.array_compact(F.array(F.lit(None).cast("string"), *labels)).alias("base"),
    )


def word_order(docs: DataFrame, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """All words of the templates, those in the fewest documents first."""
    listed = sorted({w for _, text in templates for w in text.split(" ")})
    words = F.array_distinct(F.split(F.lower("text"), GAP))
    inside = docs.select(F.explode(F.array_intersect(words, F.lit(listed))).alias("word"))
    count = {r["word"]: r["n"] for r in inside.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word
    return sorted(listed, key=lambda w: (count.get(w, 0), w))


def template_matches(docs: DataFrame, scan: Scan) -> DataFrame:
    """doc_id, key, block, label, score: every block that meets a template."""
    order = word_order(docs, scan.templates)
    place = {w: i for i, w in enumerate(order)}
    index, prefixes = [], set()
    for number, (label, text) in enumerate(scan.templates):
        words = sorted(set(text.split(" ")), key=place.__getitem__)
        need = needed(len(words), scan.threshold)
        for i, w in enumerate(words[: len(words) - need + 1]):
            index.append((w, number, label, i, len(words), need, words))
            prefixes.add(w)
    least = min(x[5] for x in index)
    spark = docs.sparkSession
    schema = "word string, template int, label string, place int, size int, need int, words array<string>"
    # As large as the templates, which are given as a parameter.
    index_table = F.broadcast(spark.createDataFrame(index, schema))
    # Lower case of a word of ASCII letters is the same by either rule; what follows is exact.
    likely = F.arrays_overlap(F.split(F.lower("text"), GAP), F.lit(sorted(prefixes)))
    blocks = docs.where(likely).select(
        "doc_id", "key", F.posexplode(F.split(F.translate("text", UPPER, LOWER), BLOCK_END)).alias("block", "line")
    )
    own = F.array_intersect(F.lit(order), F.split("line", GAP))
    sized = blocks.select("doc_id", "key", "block", own.alias("own")).where(F.size("own") >= least)
    tokens = sized.select("doc_id", "key", "block", "own", F.posexplode("own").alias("at", "word"))
    met = tokens.join(index_table, "word")
    left = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("own") - F.col("at") - 1)
    shared = F.size(F.array_intersect("words", "own"))
    # `left` counts from the first shared word only: of a pair's candidates that one is kept.
    first = F.get(F.array_intersect("own", "words"), F.lit(0)) == F.col("word")
    passed = met.where((F.size("own") >= F.col("need")) & first & (left >= F.col("need"))).withColumn("shared", shared)
    return passed.where(F.col("shared") >= F.col("need")).select(
        "doc_id", "key", "block", "label", (F.col("shared") / F.col("size")).alias("score")
    )


def license_scan(docs: DataFrame, scan: Scan | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scan = scan or Scan()
    texts = prefixed(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = texts.withColumn("key", F.xxhash64("text"))
    base = phrase_counts(keyed, scan)
    matches = template_matches(keyed, scan).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best")
    )
    matches = stored(matches, "license-matches")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    labels = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    return base.join(matches, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        _join_labels(F.col("base")).alias("base_labels"),
        _join_labels(labels).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
