"""Operator 6, license scans: an exact set-similarity join of text blocks with templates.

A block is a window of consecutive words, whatever lines they stand in, as the set
of its words; for each template it is a ninth longer than it. It matches if it holds
at least ``CONTAINED`` of the template's distinct words. Only words of templates
count for that, so a text is cut down to their places, and texts with fewer of them
than the smallest overlap any template needs fall to the length filter at once. The
rest is a join on words in one global order, rarest first by their number in all
texts: a template of n words that needs a of them shares one of its first n - a + 1
words with every match (prefix filter), and from there on the words around the place
must hold a of the template's (length and positional filter). The windows over the
place are then counted. Template rows and word counts are bounded by the templates,
which are parameters.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import NONWORD, Scratch, let, lower_ascii, pick, table

CONTAINED = Fraction(9, 10)
#: Places of template words that are joined together; longer lists go in pieces that overlap by a window.
PIECE = 256
#: Label and text of each template.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("all-rights-reserved", "All rights reserved"),
]
#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def template_sets(templates=TEMPLATES) -> list[tuple[int, str, list[str], int, int]]:
    """Number, label, distinct words, least overlap and words of a window of each template."""
    out = []
    for i, (label, text) in enumerate(templates):
        found = re.findall(f"[^{NONWORD}]+", text.lower())
        words = sorted(set(found))
        out.append((i, label, words, math.ceil(CONTAINED * len(words)), math.floor(len(found) / CONTAINED)))
    return out


def flat_words(text: Column) -> Column:
    """The words, lower-cased, with one space between each two."""
    return F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), f"[{NONWORD}]+", " "), F.lit(" "))


def with_places(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_n_words, _n_base, _first_word, _last_word, _base`` (labels) by the places of the phrases."""
    anyone = " (?=(?:" + "|".join(PHRASES) + ") )"

    def places(t: Column) -> Column:
        def spaces(x: Column) -> Column:
            return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

        padded = F.concat(F.lit(" "), t, F.lit(" "))
        n = F.when(t == "", 0).otherwise(spaces(t) + 1)
        parts = F.when(F.contains(padded, F.lit(" license ")), F.split(padded, anyone)).otherwise(F.array(padded))

        # a piece begins with its own word but for the first, which begins with a space
        def of(p: Column) -> Column:
            found = F.size(p) > 1
            last = F.get(p, F.size(p) - 1)
            return F.struct(
                n.cast("long").alias("n_words"), (F.size(p) - 1).cast("long").alias("n_base"),
                F.when(found, spaces(F.get(p, F.lit(0)))).cast("long").alias("first_word"),
                F.when(found, n - spaces(last)).cast("long").alias("last_word"),
                F.filter(F.array(*[F.when(F.contains(padded, F.lit(f" {k} ")), F.lit(v)) for k, v in PHRASES.items()]), lambda x: x.isNotNull()).alias("base"))

        return let(parts, of)

    return df.withColumn("_p", let(flat_words(F.col(text)), places)).select(*df.columns, *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base")])


def template_words(text: Column, vocabulary: list[str], least: int) -> Column:
    """Place and word of each word of the vocabulary, in order; none where fewer than ``least`` differ."""
    found = F.filter(F.transform(F.split(flat_words(text), " "), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda h: h["word"].isin(vocabulary))
    return let(found, lambda h: F.when(F.size(F.array_distinct(words_in(h))) >= least, h).otherwise(F.slice(h, 1, 0)))


def words_in(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["word"])


def pieces(hits: Column, overlap: int) -> Column:
    """``hits`` in pieces of ``PIECE`` and ``overlap`` more; windows of a piece start before place ``until``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hits) - 1, F.lit(0)), F.lit(PIECE))
    return F.transform(starts, lambda b: F.struct(F.slice(hits, b + 1, F.lit(PIECE + overlap)).alias("o"), F.coalesce(F.get(hits, b + PIECE)["at"], F.lit(2**31 - 1)).alias("until")))


def containment_join(texts: DataFrame, templates: list[tuple[int, str, list[str], int, int]]) -> DataFrame:
    """``row, template, contained``: the best window of each text (``row, hits``) for each template it matches."""
    spark = texts.sparkSession
    counted = {r["w"]: r["n"] for r in texts.select(F.explode("hits.word").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = []
    for t, _, words, need, span in templates:
        order = sorted(words, key=lambda w: (counted.get(w, 0), w))
        index += [(w, t, i, need, span, order) for i, w in enumerate(order[: len(words) - need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(index, "word string, template int, i int, need int, span int, all array<string>"))
    rare = sorted({w for w, *_ in index})
    cut = texts.filter(F.size("hits") > 0).select("row", F.explode(pieces(F.col("hits"), max(span for *_, span in templates))).alias("c")).select("row", "c.o", "c.until")
    probes = cut.select("row", "o", "until", F.explode(F.filter("o", lambda h: h["word"].isin(rare))).alias("p")).select("row", "o", "until", F.col("p.at").alias("at"), "p.word")

    def best(near: Column) -> Column:
        # the probe is the first word that a window shares, so the window has no word of the template before it in the order
        ahead = F.array_intersect(F.slice("all", F.col("i") + 1, F.size("all")), words_in(near))
        starts = F.filter(near, lambda h: (h["at"] <= F.col("at")) & (h["at"] < F.col("until")))
        shared = F.transform(starts, lambda s: F.size(F.array_intersect("all", words_in(F.filter(near, lambda h: (h["at"] >= s["at"]) & (h["at"] < s["at"] + F.col("span")))))))
        return F.when(F.size(ahead) >= F.col("need"), F.array_max(shared))

    around = F.filter("o", lambda h: (F.abs(h["at"] - F.col("at")) < F.col("span")) & F.array_contains("all", h["word"]))
    met = probes.join(prefixes, "word").select("row", "template", "need", F.size("all").alias("n"), let(around, best).alias("shared")).filter("shared >= need")
    return met.groupBy("row", "template").agg(F.max(F.col("shared") / F.col("n")).alias("contained"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document.

    The method adds the labels of matching templates; the score is 1 with a base
    place, else the best containment, else 0. Null and empty texts have no words;
    very long ones are scanned whole; equal ids and repeated rows are scanned each;
    an empty table gives none; further columns don't matter.
    """
    templates = template_sets()
    vocabulary = sorted({w for _, _, ws, *_ in templates for w in ws})
    scratch = Scratch(spark, "op6")
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    scanned = with_places(docs.withColumn("_hits", template_words(F.col("text"), vocabulary, min(need for *_, need, _ in templates))), "text")
    slim = scratch.save(scanned.drop("text").withColumn("_row", F.monotonically_increasing_id()))
    labels = F.broadcast(spark.createDataFrame([(t, label) for t, label, *_ in templates], "t int, label string"))
    found = containment_join(slim.select(F.col("_row").alias("row"), F.col("_hits").alias("hits")), templates).join(labels, F.col("template") == F.col("t")).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("contained").alias("best"))
    out = slim.drop("_hits").join(found, F.col("_row") == F.col("row"), "left")
    both = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("found", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_base").alias("n_base"), F.col("_first_word").alias("first_word"), F.col("_last_word").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("_n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    rows = ", ".join(f"({t}, '{label}', [{', '.join(repr(w) for w in ws)}], {a}, {n})" for t, label, ws, a, n in template_sets())
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t(t, label, ws, need, span) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {fold} AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, '{word}') AS w FROM d),
p AS (
  SELECT rid, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
                      WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label
  FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM w)
), b AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM p WHERE label IS NOT NULL GROUP BY rid),
m AS (
  SELECT rid, label, k / len(ws) AS c, k, need
  FROM (SELECT rid, label, ws, need, list_max(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(ws, w[i:i + span - 1])))) AS k FROM w, t WHERE len(list_intersect(ws, w)) >= need)
), f AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS c FROM m WHERE k >= need GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo AS first_word, b.hi AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


SQL = _sql()
