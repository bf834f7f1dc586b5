"""Licence scan: a positional rare-token index over licence notices, in DataFrame functions only.

The index holds, of every notice, its words with the highest inverse document frequency over the notices (its rare
words) and the postings of each: the word's positions in the notice.  A file's own rare words are those of the
vocabulary that it holds; for each notice the LOOKUP rarest of them are looked up.  Every place of such a word votes
for the starts that its postings allow; starts with two votes at least, so places where two postings meet at the right
relative position, are candidates.  At a candidate all mandatory key phrases must stand word by word, and the share of
the notice's IDF weight that stands at its relative position is the coverage.

All work is one narrow projection: nothing is shuffled, and a document of any length is a row of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words kept of each notice, those of them looked up in a file, and the coverage from which a notice is found.
RARE, LOOKUP, MIN_COVER = 8, 4, 0.6


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words of the notice
    keys: tuple[str, ...]  # its mandatory key phrases, parts of the text
    base: bool = False  # every place of the (one) key phrase counts, whatever the coverage


#: Base phrases stand within the notice that they usually come from; the other notices are the method's own.
NOTICES = (
    Notice("mit", "this software is released under the mit license", ("mit license",), True),
    Notice("apache", "licensed under the apache license version 2 0", ("apache license",), True),
    Notice("gpl", "licensed under the gnu general public license version 3", ("general public license",), True),
    Notice("mit-notice", "released under the mit license", ("the mit license",)),
    Notice(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Notice(
        "apache-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at",
        ("you may not use this file except in compliance with the license",),
    ),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Notice(
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ("redistribute it and or modify it under the terms of the gnu", "any later version"),
    ),
    Notice("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Notice(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    Notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("use in source and binary forms",),
    ),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


@dataclass(frozen=True)
class Entry:
    """A notice in the index: words, weights in thousandths, key phrases with their places, rare words from rare to
    frequent with their positions."""

    notice: Notice
    words: tuple[str, ...]
    weights: tuple[int, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    rare: tuple[str, ...]
    postings: dict[str, tuple[int, ...]]


def build_index(notices: tuple[Notice, ...] = NOTICES) -> list[Entry]:
    df: dict[str, int] = {}
    for n in notices:
        for w in set(n.text.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: round(1000 * math.log((1 + len(notices)) / c)) for w, c in df.items()}
    out = []
    for n in notices:
        words, keys = n.text.split(), []
        for key in (k.split() for k in n.keys):
            at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
            if at is None or len(key) < 2:
                raise ValueError(f"{n.label}: a key phrase is not a part of the notice, or a single word")
            keys.append((at, tuple(key)))
        by_idf = sorted(dict.fromkeys(keys[0][1] if n.base else words), key=lambda w: (-idf[w], -len(w), w))
        rare = tuple(by_idf if n.base else by_idf[:RARE])
        voted = keys[0][1] if n.base else words  # of a base notice, the places that are voted for are those of its phrase
        postings = {w: tuple(i for i, x in enumerate(voted) if x == w) for w in rare}
        out.append(Entry(n, tuple(words), tuple(idf[w] for w in words), tuple(keys), rare, postings))
    return out


def _origin(e: Entry) -> int:
    """Where in the notice the voted start lies."""
    return e.keys[0][0] if e.notice.base else 0


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _literal(values: tuple) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _votes(e: Entry) -> Column:
    """The starts that the places of the file's rarest words of this notice vote for, in order."""
    looked = F.slice(F.array_intersect(_literal(e.rare), F.col("own")), 1, len(e.rare) if e.notice.base else LOOKUP)
    postings = F.create_map(*[x for w in e.rare for x in (F.lit(w), _literal(e.postings[w]))])
    starts = F.transform(
        F.filter("places", lambda i: F.array_contains(looked, F.get(F.col("words"), i))),
        lambda i: F.transform(F.element_at(postings, F.get(F.col("words"), i)), lambda p: i - p),
    )
    none = F.expr("CAST(array() AS ARRAY<INT>)")
    return F.when(F.size(looked) >= 2, F.array_sort(F.flatten(starts))).otherwise(none)


def _verified(e: Entry, votes: str) -> Column:
    """(start, coverage) of the starts with two votes at which all key phrases stand."""
    candidates = F.array_distinct(F.filter(votes, lambda v, j: v == F.get(F.col(votes), j + 1)))
    by = _origin(e)

    def stands(s: Column) -> Column:
        ok = F.lit(True)
        for at, key in e.keys:
            ok &= (s + (at - by) >= 0) & (F.slice("words", F.greatest(s + (at - by), F.lit(0)) + 1, len(key)) == _literal(key))
        return ok

    words, weights = _literal(e.words), _literal(e.weights)

    def cover(s: Column) -> Column:
        got = lambda acc, j: acc + F.when(F.get(F.col("words"), s + j - by) == F.get(words, j), F.get(weights, j)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(e.words) - 1)), F.lit(0), got) / F.lit(float(sum(e.weights)))

    return F.transform(F.filter(candidates, stands), lambda s: F.struct(s.alias("s"), cover(s).alias("c")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document, in the rows' own order, with columns

    doc_id, n_words, n_base (all places of base phrases), first_word and last_word (their smallest and largest
    start in words from 0, else null), base_labels and labels (distinct, sorted, comma-joined), score (the largest
    coverage of a notice at a place where its key phrases stand, 0 if there is none: low for a mere mention of a base
    phrase, 1 for a whole notice), n_notices (places of base phrases, and of other notices with MIN_COVER).

    A null, empty or wordless text gives 0 words, no labels and score 0; a null id stays null; repeated rows are
    repeated; ties between notices need no order, as labels are sorted and the score is a maximum; an empty table
    gives no rows; other columns are not read.
    """
    index = build_index(notices)
    vocabulary = _literal(tuple(sorted({w for e in index for w in e.rare})))
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("own", F.array_intersect("words", vocabulary))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("own", F.get(F.col("words"), i)))
    rows = rows.withColumn("places", F.when(F.size("own") >= 2, places))
    rows = rows.select("*", *[F.when(F.col("places").isNotNull(), _votes(e)).alias(f"v{k}") for k, e in enumerate(index)])
    rows = rows.select("doc_id", F.size("words").alias("n"), *[F.when(F.size(f"v{k}") >= 2, _verified(e, f"v{k}")).alias(f"f{k}") for k, e in enumerate(index)])
    none = F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, c: DOUBLE>>)")
    enough = lambda k, e: F.col(f"f{k}") if e.notice.base else F.filter(f"f{k}", lambda x: x["c"] >= MIN_COVER)
    numbered = list(enumerate(index))
    rows = rows.select("doc_id", "n", *[F.col(f"f{k}") for k, _ in numbered], *[F.coalesce(enough(k, e), none).alias(f"g{k}") for k, e in numbered])
    base = F.flatten(F.array(*[F.col(f"g{k}")["s"] for k, e in numbered if e.notice.base]))
    scores = [F.coalesce(F.array_max(F.col(f"f{k}")["c"]), F.lit(0.0)) for k, _ in numbered]

    def labels(of: list[tuple[int, Entry]]) -> Column:
        named = [F.when(F.size(f"g{k}") > 0, F.lit(e.notice.label)) for k, e in of]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))), ",")

    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        labels([x for x in numbered if x[1].notice.base]).alias("base_labels"),
        labels(numbered).alias("labels"),
        F.round(F.greatest(*scores), 6).alias("score"),
        sum((F.size(f"g{k}") for k, _ in numbered), F.lit(0)).cast("long").alias("n_notices"),
    )


def oracle() -> str:
    """The same in DuckDB SQL, over every place of the first key phrase instead of votes."""
    index = build_index()
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    found, lists = [], []
    for k, e in enumerate(index):
        by = e.keys[0][0]  # a place is the start of the first key phrase
        tests = [f"w[x + 1 : x + {len(e.keys[0][1])}] = {quoted(e.keys[0][1])}"]
        tests += [f"x + {at - by} >= 0 AND w[x + {at - by + 1} : x + {at - by + len(key)}] = {quoted(key)}" for at, key in e.keys[1:]]
        lists.append(f"list_filter({quoted(e.rare)}, lambda r: list_contains(w, r))[1:{len(e.rare) if e.notice.base else LOOKUP}] AS r{k}")
        here = f"x + j - {by} >= 0 AND w[x + j - {by} + 1] = {quoted(e.words)}[j + 1]"
        if not e.notice.base:
            tests.append(f"len(list_filter(range({len(e.words)}), lambda j: {here} AND list_contains(r{k}, {quoted(e.words)}[j + 1]))) >= 2")
        cover = f"list_sum(list_transform(range({len(e.words)}), lambda j: CASE WHEN {here} THEN {list(e.weights)}[j + 1] ELSE 0 END)) / {float(sum(e.weights))!r}::DOUBLE"
        places = f"list_transform(list_filter(range(len(w)), lambda x: {' AND '.join(tests)}), lambda x: {{'s': x, 'c': {cover}}})"
        found.append(f"CASE WHEN list_has_all(w, {quoted(e.keys[0][1])}) THEN {places} ELSE [] END AS f{k}")
    kept = [f"f{k} AS g{k}" if e.notice.base else f"list_filter(f{k}, lambda y: y.c >= {MIN_COVER}) AS g{k}" for k, e in enumerate(index)]
    base = [k for k, e in enumerate(index) if e.notice.base]

    def labels(ks: list[int]) -> str:
        items = ", ".join(f"CASE WHEN len(g{k}) > 0 THEN '{index[k].notice.label}' END" for k in ks)
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{items}], lambda y: y IS NOT NULL))), ','), '')"

    starts = " || ".join(f"list_transform(g{k}, lambda y: y.s)" for k in base)
    scores = ", ".join(f"coalesce(list_max(list_transform(f{k}, lambda y: y.c)), 0)" for k in range(len(index)))
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), looked AS (
  SELECT doc_id, w, {", ".join(lists)} FROM words
), found AS (
  SELECT doc_id, len(w) AS n, {", ".join(found)} FROM looked
), kept AS (
  SELECT *, {", ".join(kept)} FROM found
)
SELECT doc_id, n::BIGINT AS n_words, len({starts})::BIGINT AS n_base,
  list_min({starts})::BIGINT AS first_word, list_max({starts})::BIGINT AS last_word,
  {labels(base)} AS base_labels, {labels(list(range(len(index))))} AS labels,
  round(greatest({scores}), 6) AS score,
  ({" + ".join(f"len(g{k})" for k in range(len(index)))})::BIGINT AS n_notices
FROM kept"""
