"""Operator 11: license scans by a positional index of rare words, with DataFrame functions
only.

Templates are phrases (all of their words, one after the other) and notices (longer texts,
which may be edited). An index says for each template's rarest words, those with the
highest inverse document frequency over all documents, where they stand in the template.

1. The words of a file that the index has are looked up. A hit of a word at place i, which
   stands at p in a template, is a vote for the template's start at i - p. Starts of a
   phrase are exact; those of a notice are dealt into cells of SLIP words in two grids, one
   half a cell beside the other, so that starts which differ by edits still meet.
2. Votes are intersected by relative position: sorted as numbers (template, start, word),
   equal starts stand together, and a start with enough different words is a candidate.
3. A candidate phrase is verified word by word. A candidate notice counts if its mandatory
   phrases stand at their places, which is one more vote by relative position.

All of this is arithmetic on arrays inside one row: no shuffle beside the count of
document frequencies, and linear (but for the sort of the votes) in the words of a text.

Defined results: null and empty texts, and texts without words, have no words and no
labels; repeated rows are scanned one by one; ties of document frequency go by the word;
an empty table gives no rows; other columns ride along in a struct and may have any name.
Templates have at most 4,095 words, and there may be 1,023 of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import let

# The phrases and labels of the contract.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Further phrases by which licences are named.
NAMES = [
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license version 2 0", "apache-2.0"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "creative-commons"),
    ("all rights reserved", "all-rights-reserved"),
]
#: Notices: text, label, phrases that must stand in it.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-notice", ["permission is hereby granted", "without restriction"]),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc-notice", ["with or without fee", "appear in all copies"]),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-notice", ["source and binary forms", "following conditions are met"]),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-notice", ["endorse or promote products"]),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-notice", ["gnu general public license", "free software foundation"]),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-notice", ["apache license", "except in compliance with the license"]),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-notice", ["mozilla public license"]),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense-notice", ["unencumbered software released into the public domain"]),
    ("this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit", "creative-commons-notice", ["licensed under a creative commons"]),
]

#: Rare words of a phrase and of a notice, and the share of a notice's that must meet.
PHRASE_WORDS, NOTICE_WORDS, SHARE = 2, 8, 0.6
#: Words by which the starts that a notice's words vote for may differ.
SLIP = 16
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Votes are (template * _PLACES + start) * _RANKS + number of the word.
_PLACES, _RANKS, _SHIFT = 1 << 40, 16, 4096


@dataclass(frozen=True)
class Template:
    """words; label (None: a mandatory phrase only); keys: numbers of the mandatory phrases
    and their places (none: the template is a phrase itself); base: of the contract."""

    words: tuple[str, ...]
    label: str | None
    keys: tuple[tuple[int, int], ...] = ()
    base: bool = False


def templates(base=BASE, names=NAMES, notices=NOTICES) -> list[Template]:
    """Phrases first, then notices."""
    phrases = {tuple(p.split()): Template(tuple(p.split()), label, base=(p, label) in base) for p, label in [*base, *names]}
    for _, _, keys in notices:
        for k in keys:
            phrases.setdefault(tuple(k.split()), Template(tuple(k.split()), None))
    number = {words: i for i, words in enumerate(phrases)}
    out = list(phrases.values())
    for text, label, keys in notices:
        words = tuple(text.split())
        at = [next(i for i in range(len(words)) if words[i : i + len(k.split())] == tuple(k.split())) for k in keys]
        out.append(Template(words, label, tuple((number[tuple(k.split())], i) for k, i in zip(keys, at))))
    return out


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _LETTERS, _LETTERS.lower()))
    return F.array_remove(F.split(lower, _BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each word of ``vocabulary`` (bounded by
    the templates). A task sends one row for each word."""
    held = F.concat(F.array_intersect(words_of(F.col("text").cast("string")), F.array(*map(F.lit, vocabulary))), F.array(F.lit("")))
    found = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


@dataclass(frozen=True)
class Index:
    """``rare``: each template's rarest words with their weights (thousandths of the
    inverse document frequency, 1 at least); ``need``: how many must meet."""

    templates: list[Template]
    rare: list[list[tuple[str, int]]]
    need: list[int]

    @staticmethod
    def of(docs: DataFrame, known: list[Template]) -> Index:
        total, df = document_frequencies(docs, sorted({w for t in known for w in t.words}))
        weight = lambda w: math.floor(1000 * math.log((total + 1) / (df.get(w, 0) + 1))) + 1
        rare = [[(w, weight(w)) for w in sorted(set(t.words), key=lambda w: (df.get(w, 0), w))[: NOTICE_WORDS if t.keys else PHRASE_WORDS]] for t in known]
        return Index(known, rare, [math.ceil(SHARE * len(r)) if t.keys else len(r) for t, r in zip(known, rare)])

    def votes(self, template: int, rank: int, place: int) -> list[tuple[int, int, int, int]]:
        """How a hit at i votes: add + times * ((i + move) div width)."""
        add = template * _PLACES * _RANKS + rank
        if not self.templates[template].keys:
            return [(_SHIFT - place, 1, _RANKS, add)]
        return [(_SHIFT - place + grid * SLIP // 2, SLIP, 2 * _RANKS, add + grid * _RANKS) for grid in (0, 1)]

    def postings(self) -> dict[str, list[tuple[int, int, int, int]]]:
        out: dict[str, list] = {}
        for t, (template, rare) in enumerate(zip(self.templates, self.rare)):
            for k, (w, _) in enumerate(rare):
                for p in (p for p, x in enumerate(template.words) if x == w):
                    out.setdefault(w, []).extend(self.votes(t, k, p))
        return out

    def uses(self) -> list[list[tuple[int, int, int, int]]]:
        """How a place of each phrase votes for the notices it is mandatory in."""
        out: list[list] = [[] for t in self.templates if not t.keys]
        for t, template in enumerate(self.templates):
            for j, (phrase, place) in enumerate(template.keys):
                out[phrase] += self.votes(t, j, place)
        return out


_VOTES = "array<struct<move:long,width:long,times:long,add:long>>"
_FOUND = "struct<words:long,places:array<struct<phrase:int,start:long>>,notices:array<struct<notice:int,near:long,mass:long>>>"


def _literal(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(x).cast("long") for x in r]) for r in rows]).cast(_VOTES)


def _voted(votes: Column, at: Column) -> Column:
    at = at.cast("long")
    return F.transform(votes, lambda v: v["add"] + v["times"] * F.call_function("div", at + v["move"], v["width"]))


def _met(votes: Column, need: Column) -> Column:
    """Of votes for starts: (start with its template, the votes for it), as many as needed.
    Sorted, the votes for a start stand together, at most _RANKS of them."""
    start = lambda v: F.shiftright(v, 4)

    def groups(v):
        first = F.filter(F.sequence(F.lit(1), F.size(v)), lambda i: F.when(i == 1, True).otherwise(start(F.element_at(v, i - 1)) != start(F.element_at(v, i))))
        of = lambda i: let(start(F.element_at(v, i)), lambda s: F.struct(s.alias("start"), F.filter(F.slice(v, i, F.lit(_RANKS)), lambda x: start(x) == s).alias("votes")))
        return F.filter(F.transform(first, of), lambda g: F.size(g["votes"]) >= F.element_at(need, _template(g["start"]) + 1))

    none = F.array().cast("array<struct<start:long,votes:array<long>>>")
    return let(F.array_sort(F.array_distinct(votes)), lambda v: F.when(F.size(v) == 0, none).otherwise(groups(v)))


def _template(start: Column) -> Column:
    return F.shiftright(start, 40).cast("int")


def _place(start: Column) -> Column:
    return start.bitwiseAND(F.lit(_PLACES - 1))


def _scan(words: Column, index: Index) -> Column:
    """All that is found in a text's words, as _FOUND."""
    known, postings = index.templates, index.postings()
    phrases = sum(not t.keys for t in known)
    table = F.create_map(*[x for w, rows in sorted(postings.items()) for x in (F.lit(w), _literal(rows))])
    uses = F.array(*[_literal(rows) for rows in index.uses()])
    texts = F.array(*[F.array(*map(F.lit, t.words)) for t in known[:phrases]])
    need = F.array(*map(F.lit, index.need))
    # a notice's mandatory phrases, and that it is a candidate, are votes of the second round
    key_need = F.array(*[F.lit(len(t.keys) + 1) for t in known])
    weights = F.array(*[F.array(*[F.lit(w).cast("long") for _, w in r]) for r in index.rare])

    def verified(met):
        def same(g):
            start, own = _place(g["start"]) - _SHIFT, F.element_at(texts, _template(g["start"]) + 1)
            return F.when((_template(g["start"]) < phrases) & (start >= 0), F.slice(words, (start + 1).cast("int"), F.size(own)) == own).otherwise(False)

        place = lambda g: F.struct(_template(g["start"]).alias("phrase"), (_place(g["start"]) - _SHIFT).alias("start"))
        return let(F.transform(F.filter(met, same), place), lambda places: F.struct(places.alias("places"), noticed(met, places).alias("notices")))

    def noticed(met, places):
        candidates = F.filter(met, lambda g: _template(g["start"]) >= phrases)
        own = F.transform(candidates, lambda g: g["start"] * _RANKS + F.element_at(key_need, _template(g["start"]) + 1) - 1)
        keys = F.flatten(F.transform(places, lambda p: _voted(F.element_at(uses, p["phrase"] + 1), p["start"])))
        sure = F.transform(_met(F.concat(own, keys), key_need), lambda g: g["start"])
        # the first round's votes for sure starts, found among all by one hashed intersection
        every = F.flatten(F.transform(sure, lambda s: F.sequence(s * _RANKS, s * _RANKS + (_RANKS - 1))))
        votes = F.array_intersect(F.flatten(F.transform(candidates, lambda g: g["votes"])), every)
        mass = lambda g: F.aggregate(g["votes"], F.lit(0).cast("long"), lambda a, v: a + F.element_at(F.element_at(weights, _template(g["start"]) + 1), v.bitwiseAND(F.lit(_RANKS - 1)).cast("int") + 1))
        row = lambda g: F.struct(_template(g["start"]).alias("notice"), near(g["start"]).alias("near"), mass(g).alias("mass"))
        some = F.transform(_met(votes, need), row)
        return F.when(F.size(candidates) == 0, F.array().cast("array<struct<notice:int,near:long,mass:long>>")).otherwise(some)

    def near(start):
        """The middle of a cell."""
        place = _place(start)
        return F.greatest(F.call_function("div", place, F.lit(2).cast("long")) * SLIP + SLIP // 2 - place.bitwiseAND(F.lit(1).cast("long")) * (SLIP // 2) - _SHIFT, F.lit(0).cast("long"))

    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(list(postings)), i)))
    votes = lambda at: F.flatten(F.transform(at, lambda i: _voted(F.element_at(table, F.get(words, i)), i)))
    kind = _FOUND.replace("words:long,", "")
    none = F.from_json(F.lit('{"places": [], "notices": []}'), kind)
    return let(hits, lambda at: F.when(F.size(at) == 0, none).otherwise(let(_met(votes(at), need), verified)))


def find_licenses(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """Rows of ``docs`` (struct row) with n_words, places (phrase: number of the template;
    start: word from 0) and notices (notice: number; near: about where it starts; mass: the
    weights of its rare words there, total: of all)."""
    known = known or templates()
    index = Index.of(docs, known)
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _scan(w, index).alias("f"))).alias("found"))
    total = F.array(*[F.lit(sum(w for _, w in r)).cast("long") for r in index.rare])
    full = lambda n: F.struct(n["notice"].alias("notice"), n["near"].alias("near"), n["mass"].alias("mass"), F.element_at(total, n["notice"] + 1).alias("total"))
    return rows.select("row", F.col("found.n").alias("n_words"), F.col("found.f.places").alias("places"), F.transform("found.f.notices", full).alias("notices"))


def labelled(found: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """Adds base (places of the contract's phrases), base_labels and labels (sorted arrays)
    and score: 0.5 for a phrase alone, up to 1 with the share of the best notice's weight."""
    known = known or templates()
    label = F.array(*[F.lit(t.label) for t in known])
    of = lambda n: F.element_at(label, n + 1)
    base = F.filter("places", lambda p: p["phrase"].isin([i for i, t in enumerate(known) if t.base]))
    sorted_ = lambda a: F.array_sort(F.array_distinct(F.array_compact(a)))
    named = F.concat(F.transform("places", lambda p: of(p["phrase"])), F.transform("notices", lambda n: of(n["notice"])))
    best = F.array_max(F.transform("notices", lambda n: F.lit(0.5) + n["mass"] / (2 * n["total"])))
    mention = F.exists("places", lambda p: of(p["phrase"]).isNotNull())
    with_base = found.withColumn("base", base)
    return with_base.select("*", sorted_(F.transform("base", lambda p: of(p["phrase"]))).alias("base_labels"), sorted_(named).alias("labels"), F.coalesce(best, F.when(mention, 0.5).otherwise(0.0)).alias("score"))


def scan_rows(docs: DataFrame) -> DataFrame:
    """The rows of the contract."""
    rows = labelled(find_licenses(docs.select("doc_id", "text")))
    starts = F.transform("base", lambda p: p["start"])
    return rows.select("row.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _oracle() -> str:
    """DuckDB: phrases compared at every word; votes of rare words and of mandatory phrases
    counted by groups."""
    known = templates()
    phrases = sum(not t.keys for t in known)
    quote = lambda s: "NULL" if s is None else f"'{s}'"
    rows = lambda items: ", ".join(f"({', '.join(map(str, r))})" for r in items)
    clean = rf"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '{_BETWEEN}', ' ', 'g'), '[^ ]+')"
    bucket = f"2 * ((i - p + {_SHIFT} + g * {SLIP // 2}) // {SLIP}) + g"
    return f"""
WITH tw(t, p, w) AS (VALUES {rows((t, p, quote(w)) for t, x in enumerate(known) for p, w in enumerate(x.words))}),
tm(t, label, base, keys) AS (VALUES {rows((t, quote(x.label), x.base, len(x.keys)) for t, x in enumerate(known))}),
ks(t, j, phrase, p) AS (VALUES {rows((t, j, f, p) for t, x in enumerate(known) for j, (f, p) in enumerate(x.keys))}),
d AS MATERIALIZED (SELECT doc_id, {clean} AS w FROM documents),
wd AS MATERIALIZED (SELECT doc_id, i - 1 AS i, x AS w FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE x IN (SELECT w FROM tw)),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM wd GROUP BY w),
wt AS (SELECT t, w, coalesce(n, 0) AS n, CAST(floor(1000 * ln(CAST((SELECT count(*) FROM d) + 1 AS DOUBLE) / (coalesce(n, 0) + 1))) AS BIGINT) + 1 AS weight FROM (SELECT DISTINCT t, w FROM tw WHERE t >= {phrases}) LEFT JOIN df USING (w)),
rare AS (SELECT *, count(*) OVER (PARTITION BY t) AS r, sum(weight) OVER (PARTITION BY t) AS total FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n, w) AS k FROM wt) WHERE k <= {NOTICE_WORDS}),
ph AS (SELECT t, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n, min(w) FILTER (p = 0) AS w FROM tw WHERE t < {phrases} GROUP BY t),
places AS MATERIALIZED (SELECT doc_id, t, i FROM wd JOIN ph USING (w) JOIN d USING (doc_id) WHERE array_to_string(d.w[i + 1:i + n], ' ') = text),
grid(g) AS (VALUES (0), (1)),
cand AS (SELECT doc_id, t, b, sum(weight) AS mass, any_value(total) AS total FROM (
  SELECT DISTINCT doc_id, t, {bucket} AS b, k, r, weight, total FROM wd JOIN rare USING (w) JOIN tw USING (t, w), grid) GROUP BY doc_id, t, b, r HAVING count(*) >= ceil({SHARE} * r)),
kv AS (SELECT doc_id, t, b FROM (SELECT DISTINCT doc_id, ks.t, {bucket} AS b, j FROM places JOIN ks ON places.t = ks.phrase, grid) JOIN tm USING (t) GROUP BY doc_id, t, b, keys HAVING count(*) = keys),
notice AS (SELECT doc_id, t, 0.5::DOUBLE + CAST(mass AS DOUBLE) / CAST(2 * total AS DOUBLE) AS share FROM cand JOIN kv USING (doc_id, t, b)),
named AS (SELECT doc_id, label, base, i, 0.5::DOUBLE AS share FROM places JOIN tm USING (t) WHERE label IS NOT NULL UNION ALL SELECT doc_id, label, false, NULL, share FROM notice JOIN tm USING (t)),
z AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM named GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN z USING (doc_id)
"""


ORACLE = _oracle()
