"""License scan: base phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a run of at most ``BLOCK_WORDS`` words of a whole text, line ends being gaps like others, and runs overlap by half: every template
stands whole in one block, also where a text wraps it over several lines.  A block matches
a template when it holds at least ``CONTAINMENT`` of the template's distinct words.  The join is exact and never compares all
blocks with all templates:

* words are ordered by how many documents of the whole table hold them, rarest first;
* whole texts: the first pass over the table, the only one, notes which words of the templates each text holds; a text that holds fewer than
  ``need`` of every template's words has no such block and is not split at all;
* prefix: with ``need`` words of ``size`` required, one of the template's ``size - need + 1`` rarest words must be in the block, so only
  these words are join keys;
* length: the block needs at least ``need`` distinct words of the templates' vocabulary;
* position: the join keeps the pair only at the first of the template's prefix words that the block holds; with it at place p of the order,
  ``size - p`` words at most can be shared, which must reach ``need``.

Templates are a parameter of bounded size; everything is a Spark expression or join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed
from ..session import reliable_checkpoint

CONTAINMENT = 0.8
BLOCK_WORDS = 256
# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening sentences of well-known licence notices, and the label of each.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z became a-z; keeps digits, a-z and everything beyond ASCII
# what is between words, in any case; listed one by one, since a regular expression looks listed characters up in one table, ranges one after the other
_GAP = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]"


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a whole word of the (ASCII) list stands in the text, in any ASCII case."""
    return text.rlike(r"(?i)(?<![0-9a-z\x{80}-\x{10FFFF}])(?:" + "|".join(words) + r")(?![0-9a-z\x{80}-\x{10FFFF}])") if words else F.lit(False)


def _split(text: Column) -> Column:
    """Words of a text in lower case, with an empty one where the text begins or ends with a gap.

    ``lower`` also changes letters beyond ASCII: the number of words stays, and words of ASCII letters are all there (a Kelvin sign adds a k).
    """
    return F.split(F.lower(text), _GAP + "+")


def _held(words: Column, vocabulary: Sequence[str]) -> Column:
    """Places (from 1) in the vocabulary of the words that an array holds, each once."""
    known = _literal(vocabulary)
    return F.transform(F.array_intersect(words, known), lambda w: F.array_position(known, w).cast("short"))


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _frequencies(held: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    rows = held.select(F.explode("held").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each word
    return {w: 0 for w in vocabulary} | {vocabulary[r["place"] - 1]: r["n"] for r in rows}


def term_frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents each word of the templates' (bounded) vocabulary stands."""
    return _frequencies(docs.select(_held(_split(F.col("text")), vocabulary).alias("held")), vocabulary)


def template_matches(texts: DataFrame, frequency: dict[str, int], templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``key``, ``label``, ``share``: templates found in each text (columns ``key`` and ``text``), with the largest containment.

    Blocks do not cross ``\\n`` here; ``scanned`` hands over each text as one line.
    """
    spark = texts.sparkSession
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    place = {w: k for k, w in enumerate(order)}
    prefix, whole = [], []
    for label, words in templates:
        terms = sorted(set(words.split()), key=place.__getitem__)
        need = math.ceil(containment * len(terms) - 1e-9)
        whole.append((label, terms, need))
        prefix += [(w, p, label, need, len(terms)) for p, w in enumerate(terms[: len(terms) - need + 1])]
    keys = sorted({p[0] for p in prefix})
    small = spark.createDataFrame(prefix, "word string, at int, label string, need int, size int").join(
        spark.createDataFrame(whole, "label string, terms array<string>, n int").drop("n"), "label"
    )
    least = min((n for _, _, n in whole), default=1)

    found = texts.where(_holds_any(F.col("text"), keys)).select("key", F.explode(F.split(lowered(F.col("text")), "\n")).alias("line"))
    found = computed(found.where(_holds_any(F.col("line"), keys)), {"words": F.regexp_extract_all("line", F.lit(f"({WORD})"), 1)})
    half = BLOCK_WORDS // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / half).cast("int") - 2, F.lit(0)))
    blocks = found.select("key", F.explode(F.transform(starts, lambda k: F.slice("words", k * half + 1, F.lit(BLOCK_WORDS)))).alias("words"))
    blocks = computed(blocks, {"words": F.array_intersect(F.array_distinct("words"), F.array(*[F.lit(w) for w in order]))})
    blocks = blocks.where(F.size("words") >= least).distinct()
    probes = blocks.select("key", "words", F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in keys]))).alias("word"))
    pairs = probes.join(F.broadcast(small), "word")  # bounded by the templates given
    shared = F.array_intersect("terms", "words")  # in the order of the template's terms, rarest first
    pairs = pairs.where((F.size("words") >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")))
    pairs = computed(pairs, {"shared": shared}).where((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("need")))
    return pairs.groupBy("key", "label").agg(F.max(F.size("shared") / F.col("size")).alias("share"))


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): base phrases, labels and score.

    ``score`` is the largest share of a template found, 1 where a base phrase stands, else 0.  A null or empty text has no words; equal
    texts get equal labels, repeated rows stay rows of their own; a null ``doc_id`` is passed on; an empty table gives an empty result.
    Templates and phrases consist of words of ASCII digits and lower-case letters.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = {w for _, t in templates for w in t.split()}
    watched = sorted(terms.union(*[p.split() for p, _ in phrases]))
    place = {w: k for k, w in enumerate(watched, 1)}

    def held(words: set[str]) -> Column:
        return F.size(F.array_intersect("held", F.array(*[F.lit(place[w]) for w in words]).cast("array<smallint>")))

    suspect = F.lit(False)
    for words in [set(t.split()) for _, t in templates]:
        suspect = suspect | (held(words) >= max(1, math.ceil(containment * len(words) - 1e-9)))
    for words in [p.split() for p, _ in phrases]:
        suspect = suspect | ((held(set(words)) == len(set(words))) & F.col("text").rlike("(?i)" + (_GAP + "+").join(words)))
    rows = computed(rows, {"words": _split(F.col("text"))})
    rows = computed(rows, {"n_words": F.size(F.array_remove("words", "")).cast("long"), "held": _held(F.col("words"), watched)}).drop("words")
    rows = computed(rows, {"suspect": suspect})
    # what follows needs the texts of the suspects alone, and of the others the words they hold: the table is read once
    rows = reliable_checkpoint(rows.withColumn("text", F.when(F.col("suspect"), F.col("text"))))
    frequency = {w: n for w, n in _frequencies(rows, watched).items() if w in terms}
    texts = rows.where("suspect").select(F.sha2("text", 256).alias("key"), F.translate("text", "\n", " ").alias("text"))
    rows = computed(rows, {"words": F.when(F.col("suspect"), F.regexp_extract_all(lowered(F.col("text")), F.lit(f"({WORD})"), 1))})
    hits = [_places(p.split()) for p, _ in phrases]
    empty = F.array().cast("array<int>")
    rows = computed(
        rows,
        {f"hit{k}": F.when(F.size("words") >= len(p.split()), h).otherwise(empty) for k, ((p, _), h) in enumerate(zip(phrases, hits, strict=True))}
        | {"key": F.when(F.col("suspect"), F.sha2("text", 256)).otherwise(F.concat(F.lit("row "), F.xxhash64("doc_id", "n_words").cast("string")))},
    )
    matches = template_matches(texts, frequency, templates, containment).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    places = F.flatten(F.array(*[F.col(f"hit{k}") for k in range(len(phrases))]))
    labels = F.array_compact(F.array(*[F.when(F.size(f"hit{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    narrow = computed(rows, {"places": places, "base": F.array_sort(F.array_distinct(labels))}).select("doc_id", "n_words", "places", "base", "key")
    return narrow.join(matches, "key", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _places(phrase: list[str]) -> Column:
    """Starts (from 0) of the phrase in the column ``words``, which must be long enough."""
    return F.filter(F.sequence(F.lit(0), F.size("words") - len(phrase)), lambda i: _all([F.get("words", i + k) == w for k, w in enumerate(phrase)]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
