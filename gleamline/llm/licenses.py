"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is ``BLOCK`` consecutive words of a text, and a new one begins every ``STEP`` words, so every template stands whole in a
block wherever it is.  A template matches a block that holds at least ``SHARE`` of its different words.

Words are ordered by how many documents hold them, the rarest first.  Of a template that needs ``m`` of its ``n`` words, a matching
block must hold one of the first ``n - m + 1`` (prefix filter); the block needs ``m`` words of templates (length filter), must
hold a shared one among its own first words, and from the places of that word in both orders ``m`` words must still
be possible (positional filter).  Only pairs that are left are compared word by word.  All filters are exact: they drop no match.

Of templates of one family that match a block, those with the largest share held, and then with the most words, give labels.
Phrases are looked for beside that, word by word; a phrase's label is always given.

The vocabulary of templates is fixed, so its counts and the literals made of them are bounded.  A text gives blocks only where
it holds one of the prefix words, and a block is bounded, so neither a long text nor a hot one meets in one task.

Defined cases: a null or empty text has no words, and the label list is empty.  Repeated rows, with or without an
identifier, are rows of their own.  Ties between templates of a family give all their labels.  A long text is
read whole.  An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleamline.llm.common import column
from gleamline.session import stage

BLOCK, STEP = 64, 32
SHARE = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, family and characteristic words of public licenses, none longer than STEP words.
TEMPLATES = [
    ("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu", "licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "gnu", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "gnu", "licensed under the gnu affero general public license version 3"),
    ("gpl", "gnu-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "cc", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]

Templates = list[tuple[str, str, str]]


def lowered(text: Column) -> Column:
    """A-Z lower-cased.  Other letters may be too, as all of them are word letters and none becomes an ASCII one."""
    plain = F.replace(F.replace(text, F.lit("İ"), F.lit("é")), F.lit("K"), F.lit("é"))
    return F.lower(plain)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def least_words(words: list[str], share: float) -> int:
    """How many of a template's words a block must hold."""
    n = len(words)
    return next(m for m in range(n + 1) if m >= share * n - 1e-9)


class Order:
    """Templates with their words as ranks, the rarest word of the corpus being 1."""

    def __init__(self, held: dict[str, int], templates: Templates, share: float):
        sets = [(label, family, sorted(set(text.split()))) for label, family, text in templates]
        self.vocabulary = sorted({w for *_, words in sets for w in words}, key=lambda w: (held.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.vocabulary, 1)}
        self.rows = [
            (label, family, sorted(rank[w] for w in words), least_words(words, share)) for label, family, words in sets
        ]
        self.prefixes = [ranks[: len(ranks) - need + 1] for *_, ranks, need in self.rows]
        self.prefix_words = [self.vocabulary[r - 1] for r in sorted({r for p in self.prefixes for r in p})]
        self.least = min((need for *_, need in self.rows), default=1)

    def table(self, spark: SparkSession) -> DataFrame:
        """(rank, place, label, family, ranks, need): a row per template and prefix word."""
        rows = [
            F.struct(
                F.lit(r).alias("rank"), F.lit(i).alias("place"), F.lit(label).alias("label"), F.lit(family).alias("family"),
                F.array(*map(F.lit, ranks)).alias("ranks"), F.lit(need).alias("need"),
            )
            for (label, family, ranks, need), prefix in zip(self.rows, self.prefixes)
            for i, r in enumerate(prefix)
        ]
        return spark.range(1).select(F.inline(F.array(*rows)))


def held_by(docs: DataFrame, words: list[str], text_col: str) -> dict[str, int]:
    """How many documents hold each of ``words``; at most one row per word comes to the driver."""
    some = F.array_intersect(words_of(column(text_col)), _strings(words))
    return {r["w"]: r["count"] for r in docs.select(F.explode(some).alias("w")).groupBy("w").count().collect()}


def places(words: str, phrase: str) -> Column:
    """Where the phrase's words stand consecutively in the array column ``words``, counted from 0."""
    parts = phrase.split()
    w = F.col(words)
    here = functools.partial(functools.reduce, operator.and_)
    whole = here([F.array_contains(w, F.lit(p)) for p in sorted(set(parts), key=len)])
    last = F.size(w) - len(parts)
    found = F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: here([F.get(w, i + j) == F.lit(p) for j, p in enumerate(parts)])
    )
    return F.when(whole & (last >= 0), found).otherwise(F.array().cast("array<int>"))


def _read(docs: DataFrame, order: Order, phrases: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """(row, doc, n_words, found, blocks), staged: phrase places, and the blocks that hold a prefix word.

    A block is its number and the ranks of its words of templates, the rarest first.
    """
    prefix, vocabulary = _strings(order.prefix_words), _strings(order.vocabulary)
    words = docs.select(column(id_col).alias("doc"), words_of(column(text_col)).alias("words"))
    found = [F.struct(F.lit(label).alias("label"), places("words", phrase).alias("at")) for phrase, label in phrases.items()]
    w = F.col("words")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / STEP).cast("int")),
        lambda k: F.struct(k.alias("block"), F.slice(w, k * STEP + 1, F.lit(BLOCK)).alias("words")),
    )
    near = F.filter(cut, lambda b: F.arrays_overlap(b["words"], prefix))

    def ranked(b: Column) -> Column:
        ranks = F.transform(F.array_intersect(b["words"], vocabulary), lambda x: F.array_position(vocabulary, x).cast("int"))
        return F.struct(b["block"].alias("block"), F.array_sort(ranks).alias("ranks"))

    blocks = F.when(F.arrays_overlap(w, prefix), F.transform(near, ranked))
    return stage(
        words.select(
            F.monotonically_increasing_id().alias("row"), "doc", F.size(w).cast("long").alias("n_words"),
            F.array(*found).alias("found"), blocks.alias("blocks"),
        )
    )


def matches(read: DataFrame, order: Order) -> DataFrame:
    """(row, block, label, family, held, share): every pair of block and template that meets the threshold."""
    blocks = read.filter(F.size("blocks") > 0).select("row", F.inline("blocks"))
    size = F.size("ranks")
    first = blocks.filter(size >= order.least).select(
        "row", "block", F.col("ranks").alias("own"), size.alias("size"),
        F.posexplode(F.slice("ranks", F.lit(1), size - order.least + 1)).alias("own_place", "rank"),
    )
    # As many rows as the fixed templates have prefix words.
    pairs = first.join(F.broadcast(order.table(read.sparkSession)), "rank")
    need = F.col("need")
    pairs = pairs.filter(
        (F.col("size") >= need)
        & (F.col("own_place") <= F.col("size") - need)
        & (F.least(F.size("ranks") - F.col("place"), F.col("size") - F.col("own_place")) >= need)
    )
    held = F.size(F.array_intersect("own", "ranks"))
    return (
        pairs.select("row", "block", "label", "family", held.alias("held"), (held / F.size("ranks")).alias("share"), "need")
        .filter(F.col("held") >= need)
        .drop("need")
        .distinct()
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates | None = None,
    phrases: dict[str, str] | None = None, share: float = SHARE,
) -> DataFrame:
    """Per document its words, phrase places and labels.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); ``score`` is 1 with a phrase, else the largest
    share of a template that a block holds, of those that meet the threshold, else 0.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    if any(len(text.split()) > STEP for *_, text in templates):
        raise ValueError(f"a template may have at most {STEP} words, so that a block holds it whole")
    vocabulary = sorted({w for *_, text in templates for w in text.split()})
    order = Order(held_by(docs, vocabulary, text_col), templates, share)
    read = _read(docs, order, phrases, id_col, text_col)
    near = Window.partitionBy("row", "block", "family").orderBy(F.desc("share"), F.desc("held"))
    labelled = (
        matches(read, order)
        .withColumn("nth", F.rank().over(near))
        .groupBy("row")
        .agg(F.collect_set(F.when(F.col("nth") == 1, F.col("label"))).alias("more"), F.max("share").alias("share"))
    )
    at = F.flatten(F.transform("found", lambda f: f["at"]))
    base = F.transform(F.filter("found", lambda f: F.size(f["at"]) > 0), lambda f: f["label"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    none = F.array().cast("array<string>")
    return read.join(labelled, "row", "left").select(
        F.col("doc").alias(id_col),
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("more", none))).alias("labels"),
        F.when(F.size(at) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def brute_sql(templates: Templates = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = SHARE) -> str:
    """DuckDB SQL for ``scan`` of ``documents`` that compares every block with every template."""
    kinds = ", ".join(
        f"('{label}', '{family}', list_distinct(string_split('{text}', ' ')), {least_words(sorted(set(text.split())), share)})"
        for label, family, text in templates
    )
    said = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in phrases.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{WORD}') AS w FROM documents
), templates(label, family, words, need) AS (VALUES {kinds}
), phrases(label, words) AS (VALUES {said}
), spots AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), phrases
  WHERE w[i + 1] = words[1] AND w[i + 1 : i + len(words)] = words
), base AS (
  SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM spots GROUP BY doc_id
), blocks AS (
  SELECT doc_id, k, list_distinct(w[{STEP} * k + 1 : {STEP} * k + {BLOCK}]) AS b
  FROM (SELECT doc_id, w, unnest(range((len(w) + {STEP - 1}) // {STEP})) AS k FROM d)
), held AS (
  SELECT doc_id, k, label, family, need, len(words) AS size, len(list_intersect(b, words)) AS m FROM blocks, templates
), near AS (
  SELECT *, rank() OVER (PARTITION BY doc_id, k, family ORDER BY CAST(m AS DOUBLE) / size DESC, m DESC) AS nth
  FROM held WHERE m >= need
), more AS (
  SELECT doc_id, list(DISTINCT label) FILTER (nth = 1) AS labels, max(CAST(m AS DOUBLE) / size) AS share FROM near GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""
