"""Licence scans by sentence identifiers and ordered rules (DataFrame functions only).

A text is split into sentences, each normalised to lower-case words; a sentence gets the identifiers of all known licence
phrases that it contains, and a text becomes the sequence of its identifiers in order of place. Rules are sequences of identifiers;
a rule matches where its identifiers follow each other in that order with no other identifier between. Rules are tried in
their order, longest sequences first, and identifiers that a match uses are not used again.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import table, without

#: Identifier letter, and the normalised phrase whose presence in a sentence gives it. Of those that begin at one word the first counts.
SENTENCES = [
    ("A", "licensed under the apache license version 2 0"),
    ("B", "you may not use this file except in compliance with the license"),
    ("C", "you may obtain a copy of the license at"),
    ("D", "distributed on an as is basis"),
    ("E", "spdx license identifier apache 2 0"),
    ("G", "licensed under the gnu general public license version 3"),
    ("H", "licensed under the gnu general public license version 2"),
    ("I", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("J", "either version 3 of the license or at your option any later version"),
    ("K", "either version 2 of the license or at your option any later version"),
    ("L", "licensed under the gnu lesser general public license"),
    ("M", "released under the mit license"),
    ("N", "licensed under the mit license"),
    ("O", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("P", "the software is provided as is without warranty of any kind"),
    ("Q", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("R", "neither the name of"),
    ("S", "licensed under cc by nc"),
    ("T", "licensed under cc by sa"),
    ("U", "licensed under cc by"),
    ("V", "released into the public domain"),
    ("W", "subject to the terms of the mozilla public license"),
    ("X", "all rights reserved"),
]
#: Licence, and the identifier sequences that stand for it, in the order in which they are tried.
RULES = [
    ("Apache-2.0", "ABCD"), ("Apache-2.0", "ABC"), ("GPL-3.0-or-later", "IJ"), ("GPL-2.0-or-later", "IK"), ("MIT", "OP"), ("BSD-3-Clause", "QR"),
    ("Apache-2.0", "A"), ("Apache-2.0", "E"), ("GPL-3.0", "G"), ("GPL-2.0", "H"), ("LGPL", "L"), ("GPL", "I"), ("MIT", "M"), ("MIT", "N"), ("MIT", "O"),
    ("BSD-2-Clause", "Q"), ("CC-BY-NC", "S"), ("CC-BY-SA", "T"), ("CC-BY", "U"), ("Public-Domain", "V"), ("MPL-2.0", "W"), ("Proprietary", "X"),
]
COLUMNS = ("n_sentences", "n_license_sentences", "sentence_ids", "licenses", "license")
#: A sentence ends at a blank line or at . ! ? before white space or the end of the text; a single line feed is white space.
BREAK = r"[.!?]+(?:[ \t\r\n]+|\z)|(?:\r\n|\r(?!\n)|\n)[ \t]*[\r\n][ \t\r\n]*"
#: What ends a sentence in the count ``n_sentences``: every line feed too.
COUNTED = r"[.!?]+(?:[ \t\r\n]+|\z)|[\r\n]+"
#: The longest word of each phrase: a text without any of them holds no phrase.
WORDS = sorted({max(p.split(), key=len) for _, p in SENTENCES})
#: Any phrase at its place; a lookahead, so that phrases may overlap.
PHRASE = rf"(?<![a-z0-9])(?=({'|'.join(p for _, p in SENTENCES)})(?![a-z0-9]))"


def scan(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with n_sentences, n_license_sentences, sentence_ids, licenses (comma-joined, in rule order) and license.

    n_sentences counts every line feed as the end of a sentence; identifiers are found across single line feeds.
    license is the first rule's that matches, or ``none``. Null and empty texts have no sentences and no licence. Repeated
    rows are judged each, an empty table gives an empty one, texts of any length are read whole; existing columns of the result's names are replaced. Only A-Z is lower-cased, and every run of
    other characters than a-z and 0-9 separates words.
    """
    docs = without(docs, *COLUMNS, "_storyspark_s")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\x01", "abcdefghijklmnopqrstuvwxyz ")

    # sentence borders become \x01, every other run of separators one space
    def sentences(ends: str) -> F.Column:
        text = F.regexp_replace(F.regexp_replace(lower, ends, "\x01"), "[^a-z0-9\x01]+", " ")
        return F.filter(F.transform(F.split(text, "\x01"), lambda s: F.trim(s)), lambda s: s != "")

    count = F.regexp_count(F.regexp_replace(lower, COUNTED, "\x01"), F.lit("[^a-z0-9\x01]*[a-z0-9][^\x01]*"))
    some = functools.reduce(lambda a, b: a | b, [lower.contains(w) for w in WORDS])
    none = F.array().cast("array<string>")

    letter = lambda p: functools.reduce(lambda other, x: F.when(p == x[1], x[0]).otherwise(other), reversed(SENTENCES), F.lit(""))
    known = lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(PHRASE), F.lit(1)), letter), "")
    # rules in order: each takes its identifiers out of the sequence (a space keeps the rest apart)
    left, names = F.col("sentence_ids"), []
    for name, seq in RULES:
        names.append(F.when(left.contains(seq), F.lit(name)))
        left = F.replace(left, F.lit(seq), F.lit(" "))
    out = docs.withColumn("n_sentences", count.cast("long")).withColumn("_storyspark_s", F.when(some, F.filter(F.transform(sentences(BREAK), known), lambda x: x != "")).otherwise(none))
    out = out.withColumn("n_license_sentences", F.size("_storyspark_s").cast("long")).withColumn("sentence_ids", F.array_join("_storyspark_s", "")).drop("_storyspark_s")
    # few documents hold an identifier at all; the rules are only tried there
    out = out.withColumn("licenses", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ",")))
    return out.withColumn("license", F.when(F.col("licenses") == "", "none").otherwise(F.substring_index("licenses", ",", 1)))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COLUMNS)


def _sql() -> str:
    """The same rule apart from the operator's code: each word is put in brackets, so that phrases share no separator, and phrases are sought by splitting."""
    phrases = ", ".join(f"({k}, '{i}', '<{p.replace(' ', '><')}>')" for k, (i, p) in enumerate(SENTENCES))
    steps, before = [], "ids"
    for k, (name, seq) in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest, found), replace(rest, '{seq}', ' ') AS rest, CASE WHEN contains(rest, '{seq}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {before})")
        before = f"r{k}"
    assert not re.search("'", "".join(p for _, p in SENTENCES))
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1), 'abcdefghijklmnopqrstuvwxyz ')"
    return rf"""
WITH d AS (SELECT doc_id, {low} AS low, row_number() OVER () AS r FROM documents
), t AS (
  SELECT r, doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(low, '[.!?]+([ \t\r\n]+|\z)|[\r\n]+', chr(1), 'g'), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS n,
    string_split(regexp_replace(regexp_replace(replace(low, chr(13) || chr(10), chr(10)), '[.!?]+([ \t\r\n]+|\z)|[\r\n][ \t]*[\r\n][ \t\r\n]*', chr(1), 'g'), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)) AS s FROM d
), u AS (SELECT r, unnest(range(len(s))) AS k, trim(unnest(s), ' ') AS x FROM t
), v AS (SELECT r, k, '<' || replace(x, ' ', '><') || '>' AS y FROM u WHERE x <> ''
), p(place, letter, pp) AS (VALUES {phrases}
), o AS (SELECT r, k, place, letter, string_split(y, pp) AS cut, length(pp) AS w FROM v JOIN p ON contains(y, pp)
), h AS (
  SELECT r, k, place, letter, unnest(list_transform(range(1, len(cut)), lambda i: list_sum(list_transform(cut[1:i], lambda x: length(x))) + (i - 1) * w)) AS pos FROM o
), f AS (SELECT r, k, pos, arg_min(letter, place) AS letter FROM h GROUP BY r, k, pos
), g AS (SELECT r, count(DISTINCT k) AS sentences, string_agg(letter, '' ORDER BY k, pos) AS sentence_ids FROM f GROUP BY r
), ids AS (SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, coalesce(sentences, 0) AS sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(sentence_ids, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM t LEFT JOIN g USING (r)), {", ".join(steps)}
SELECT doc_id, n_sentences, CAST(sentences AS BIGINT) AS n_license_sentences, sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses,
  CASE WHEN len(found) = 0 THEN 'none' ELSE found[1] END AS license FROM {before}
"""

SQL = _sql()
