"""License scans through a positional index of rare words.

Words of the licence texts are counted over all documents.  The index holds, of each
template, the INDEXED rarest words there (highest inverse document frequency) with
their places.  Of each file, the RAREST of them that it holds are looked up for each
template; every place in the file, less the posting's, says where the template would
begin.  Where SUPPORT of them agree, it is a candidate: its mandatory key phrase is
verified there, and the share of the template's words in place is its score.  Base
phrases, and others that are no longer than their key, are looked up by their two
rarest words, so that no place of one is lost.

DataFrame functions only: after the counts, one narrow step without a shuffle.

Defined results: null and empty texts have no words and no labels, an empty table
gives no rows; words of equal frequency rank by their letters; a long text is one
array of words in one row; repeated rows get their result each; only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: (label, template, key phrase); public licence texts and names.
BASE = [
    ("mit", "under the mit license", "under the mit license"),
    ("apache-2", "apache license version 2", "apache license version 2"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
]
#: Words of public licence texts, as far as they are the same in every copy, and the phrase that must stand in each.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code
must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either
in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
TEMPLATES = [
    *BASE,
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license version 2"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("mit", MIT, "hereby granted free of charge to any person"),
    ("apache-2", APACHE, "except in compliance with the license"),
    ("bsd", BSD, "in source and binary forms"),
    ("isc", ISC, "for any purpose with or without fee"),
    ("gpl", GPL, "terms of the gnu general public license"),
    ("unlicense", UNLICENSE, "free and unencumbered software"),
]
#: Share of a template's words that must stand in place.
COVER = 0.7
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; letters and digits, and everything from U+0080 on.

    Spark's lower() also changes other letters, but of them only the Kelvin sign
    becomes an ASCII one; it is replaced by another non-ASCII character first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.filter(F.split(plain, _APART), lambda w: w != "")


#: Words indexed of each template, those looked up of each file, and how many must agree on a beginning.
INDEXED, RAREST, SUPPORT = 12, 8, 3


def rarest(docs: DataFrame, templates: list[tuple[str, str, str]]) -> list[str]:
    """The templates' words, rarest over all documents first; at most as many rows as such words."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = dict(found.groupBy("w").count().collect())
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def index_words(key: list[str], rank: dict[str, int]) -> list[tuple[str, int]]:
    """The two rarest words of a phrase and their places in it."""
    order = sorted({w: i for i, w in reversed([*enumerate(key)])}.items(), key=lambda x: rank[x[0]])
    return order[:2]


def _in_place(words: Column, start: Column, body: list[str]) -> Column:
    """Share of a template's words that stand where it would have them from `start` on."""
    here = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.lit(len(body)) + F.least(start, F.lit(0)))
    cut = F.slice(F.array(*map(F.lit, body)), F.greatest(-start, F.lit(0)) + 1, F.lit(len(body)))
    return F.size(F.filter(F.zip_with(here, cut, lambda a, b: a == b), lambda x: x)) / len(body)


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _short(template: tuple[str, str, str], rank: dict[str, int]) -> Column:
    """Starts of a phrase: its two rarest words' places, less their places in it, intersected; there it is verified."""
    key = template[2].split()
    starts = [F.expr(f"transform(filter(postings, x -> x.w = '{w}'), x -> x.p - {i})") for w, i in index_words(key, rank)]
    whole = F.filter(reduce(F.array_intersect, starts), lambda s: (s >= 0) & (F.slice(F.col("words"), s + 1, len(key)) == _words(key)))
    return F.transform(whole, lambda s: F.struct(s.alias("s"), F.lit(1.0).alias("cover")))


def _indexed(template: tuple[str, str, str], rank: dict[str, int]) -> list[str]:
    return sorted(set(template[1].split()), key=rank.get)[:INDEXED]


def _long(template: tuple[str, str, str], rank: dict[str, int]) -> Column:
    """Beginnings of a template that enough of the file's rarest words agree on and that hold its key phrase: the share in place."""
    _, text, phrase = template
    body, key = text.split(), phrase.split()
    at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
    index = _indexed(template, rank)
    rare = F.slice(F.array_intersect(_words(index), F.transform("postings", lambda x: x["w"])), 1, RAREST)
    places = F.create_map(*(x for w in index for x in (F.lit(w), F.array(*(F.lit(i) for i, y in enumerate(body) if y == w)))))
    # Every occurrence of a rare word in the file, less each of its places in the template.
    said = F.array_sort(F.flatten(F.transform(F.filter("postings", lambda x: F.array_contains(rare, x["w"])), lambda x: F.transform(places[x["w"]], lambda i: x["p"] - i))))
    starts = F.array_distinct(F.filter(said, lambda s, i: F.get(said, i + (SUPPORT - 1)) == s))
    whole = F.filter(starts, lambda s: (s + at >= 0) & (F.slice(F.col("words"), F.greatest(s + at, F.lit(0)) + 1, len(key)) == _words(key)))
    scored = F.transform(whole, lambda s: F.struct(s.alias("s"), _in_place(F.col("words"), s, body).alias("cover")))
    few = F.expr("cast(array() as array<struct<s:int,cover:double>>)")
    return F.when(F.size("postings") >= SUPPORT, F.filter(scored, lambda x: x["cover"] >= COVER)).otherwise(few)


def licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, base_places (array of places of base phrases), labels and the best cover."""
    templates = templates or TEMPLATES
    rank = {w: k for k, w in enumerate(rarest(docs, templates))}
    short = [text == key for _, text, key in templates]
    index = sorted({w for t, brief in zip(templates, short, strict=True) for w in ([x for x, _ in index_words(t[2].split(), rank)] if brief else _indexed(t, rank))})
    cut = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    listed = ", ".join(f"'{w}'" for w in index)
    looked = cut.withColumn("postings", F.expr(f"filter(transform(words, (w, i) -> struct(i AS p, w AS w)), x -> x.w IN ({listed}))"))
    found = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), *((_short if brief else _long)(t, rank).alias(f"t{k}") for k, (t, brief) in enumerate(zip(templates, short, strict=True))))
    n = len(BASE)
    starts = F.concat(*(F.expr(f"transform(t{k}, x -> x.s)") for k in range(n)))
    names = lambda ks: F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"t{k}") > 0, templates[k][0]) for k in ks)))))
    best = F.greatest(F.lit(0.0), *(F.coalesce(F.array_max(F.expr(f"transform(t{k}, x -> x.cover)")), F.lit(0.0)) for k in range(len(templates))))
    return found.select("doc_id", "n_words", starts.alias("base_places"), names(range(n)).alias("base_labels"), names(range(len(templates))).alias("labels"), best.alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses(load(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc_id").cast("long"),
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _sql() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    brief, full = [], []
    for k, (label, text, phrase) in enumerate(TEMPLATES):
        key = phrase.split()
        if text == phrase:
            keyed = ", ".join(f"'{word}'" for word in key)
            brief.append(f"SELECT rid, {k} AS k, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(key)}] = [{keyed}])) AS s, 1::DOUBLE AS cover FROM cut WHERE list_contains(w, '{key[0]}')")
        else:
            body = text.split()
            at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
            full.append(f"SELECT {k} AS k, '{label}' AS label, {len(body)} AS n, {at} AS a, {at + len(key)} AS z, unnest(range(0, {len(body)})) AS i, unnest(string_split('{' '.join(body)}', ' ')) AS w")
    every = " ".join(" ".join(text.split()) for _, text, _ in TEMPLATES)
    return f"""
WITH cut AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{alphabet}', '{alphabet.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
  vocabulary AS (SELECT DISTINCT unnest(string_split('{every}', ' ')) AS w),
  template AS ({" UNION ALL ".join(full)}),
  placed AS (SELECT rid, p, w FROM (SELECT rid, unnest(range(0, len(w))) AS p, unnest(w) AS w FROM cut) SEMI JOIN vocabulary USING (w)),
  ranked AS (SELECT v.w, row_number() OVER (ORDER BY count(DISTINCT rid), v.w) AS r FROM vocabulary v LEFT JOIN placed USING (w) GROUP BY v.w),
  indexed AS (SELECT k, w, r FROM (SELECT k, w, r, row_number() OVER (PARTITION BY k ORDER BY r) AS j FROM (SELECT DISTINCT k, w FROM template) JOIN ranked USING (w)) WHERE j <= {INDEXED}),
  rare AS (SELECT rid, k, w FROM (SELECT rid, k, w, row_number() OVER (PARTITION BY rid, k ORDER BY r) AS j FROM (SELECT DISTINCT rid, w FROM placed) JOIN indexed USING (w)) WHERE j <= {RAREST}),
  said AS (SELECT rid, t.k, p - i AS s FROM placed JOIN rare USING (rid, w) JOIN template t ON t.k = rare.k AND t.w = rare.w GROUP BY rid, t.k, p - i HAVING count(*) >= {SUPPORT}),
  checked AS (SELECT said.rid, said.k, label, s, count(*) / n::DOUBLE AS cover, count(*) FILTER (i >= a AND i < z) = z - a AS keyed FROM said JOIN template t ON t.k = said.k JOIN placed d ON d.rid = said.rid AND d.p = s + i AND d.w = t.w GROUP BY said.rid, said.k, label, s, n, a, z),
  found AS ({" UNION ALL ".join(brief)} UNION ALL SELECT rid, k, label, s, cover FROM checked WHERE keyed AND cover >= {COVER}),
  summed AS (SELECT rid, count(*) FILTER (k < {len(BASE)}) AS n, min(s) FILTER (k < {len(BASE)}) AS a, max(s) FILTER (k < {len(BASE)}) AS b,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k < {len(BASE)}), '') AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(cover) AS c FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(bl, '') AS base_labels, coalesce(l, '') AS labels, coalesce(c, 0)::DOUBLE AS score
FROM cut LEFT JOIN summed USING (rid)"""


ORACLE = _sql()
