"""Licence scan by a positional rare-token index, with DataFrame functions only.

Each licence template is a run of words.  Its posting key is the word with the highest inverse document
frequency (counted over the whole corpus) in its first mandatory key phrase, with the word's place in the
template.  Every place of a posting key in a file gives an origin at which the template would have to
start; as the phrase holds its key, no place of the phrase is passed over, however many licences a file
has.  At each origin the template's mandatory key phrases are verified word by word; verified templates
give their label, and the file's score is the highest share of a verified template's rarity that stands
at its relative position.

All of a file's work is in its own row: no file is joined with another.  A file's words are read once; the
places of its template words are stored, the corpus is counted and the templates are verified from there.
Nothing but the word counts of the fixed template vocabulary (bounded by the templates) leaves the
executors.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalong.functions.text import let
from readalong.llm.common import staged, text_of

#: Words: runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base labels: every place where the phrase's words stand consecutively counts.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, template, mandatory key phrases inside it).  Fixed values: common notices, in plain words.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("creative-commons", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Words too common in any language's prose to be keys or to count; they are verified where a template asks for them.
COMMON = frozenset("a an and any are by for free in into is of or person purpose source subject terms the this to under use with without work 0 1 2 3 4".split())  # noqa: SIM905


#: Every base phrase and every template's key phrases hold one of these.
GATES = ("license", "cc", "commons", "permission", "redistribution", "reserved", "unencumbered")


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _vocabulary() -> list[str]:
    words = {w for _, template, _ in TEMPLATES for w in template.split()} | {w for phrase, _ in BASE_PHRASES for w in phrase.split()}
    return sorted(words)


def _looked_up() -> list[str]:
    return sorted({w for _, template, _ in TEMPLATES for w in template.split()} - COMMON)


def _place(parts: list[str], phrase: list[str]) -> int:
    """Where a template's key phrase starts in it."""
    return next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Licence findings of every row of ``docs``.

    Returns id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``places``
    (label, first word, matched share of each verified template).  A null text is an empty one: no words,
    no labels, score 0.  Rows may repeat; ids play no part.  A text may have any length; an empty table gives
    no rows.  Extra columns are ignored.
    """
    body = docs.select(docs[id_column].alias("id"), text_of(docs, text).alias("t"))
    files, n_files, frequency = _read(body)
    idf = {w: math.log((n_files + 1) / (frequency.get(w, 0) + 1)) + 1 for w in _looked_up()}
    at = lambda w: F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["p"])

    def base(phrase: str) -> Column:
        def starts(w: str, k: int) -> Column:
            return F.transform(at(w), lambda p: p - F.lit(k))

        parts = [starts(w, k) for k, w in enumerate(phrase.split())]
        return F.coalesce(reduce(F.array_intersect, parts), F.array().cast("array<int>"))

    files = files.withColumns({f"base_{k}": base(phrase) for k, (phrase, _) in enumerate(BASE_PHRASES)})
    places = F.concat(*[F.col(f"base_{k}") for k in range(len(BASE_PHRASES))])
    base_labels = F.filter(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE_PHRASES)]), lambda x: x.isNotNull())

    postings: dict[str, list[Column]] = {}
    for k, (_, template, phrases) in enumerate(TEMPLATES):
        sub = phrases[0].split()
        key = max(sub, key=lambda w: idf.get(w, 0.0))
        postings.setdefault(key, []).append(F.struct(F.lit(k).alias("k"), F.lit(_place(template.split(), sub) + sub.index(key)).alias("i")))
    index = F.create_map(*[x for w, v in postings.items() for x in (F.lit(w), F.array(*v))])
    sought = F.filter("hits", lambda h: h["w"].isin(list(postings)))
    origins = F.flatten(F.transform(sought, lambda h: F.transform(index[h["w"]], lambda q: F.struct(q["k"].alias("k"), (h["p"] - q["i"]).alias("at")))))
    files = files.withColumn("origins", origins)

    def verified(k: int, label: str, template: str, phrases: tuple[str, ...]) -> Column:
        parts = template.split()

        def holds(at: Column) -> Column:
            checks = []
            for phrase in phrases:
                sub = phrase.split()
                i = _place(parts, sub)
                standing = F.filter("hits", lambda h: (h["p"] >= at + i) & (h["p"] < at + i + len(sub)))
                checks.append(F.transform(standing, lambda h: h["w"]) == _strings(sub))
            return reduce(lambda a, b: a & b, checks)

        total = sum(idf.get(w, 0.0) for w in parts)
        found = F.filter("origins", lambda o: (o["k"] == k) & holds(o["at"]))

        def share(o: Column) -> Column:
            standing = F.filter("hits", lambda h: (h["p"] >= o["at"]) & (h["p"] < o["at"] + len(parts)))
            right = F.filter(standing, lambda h: F.get(_strings(parts), h["p"] - o["at"]) == h["w"])
            weight = F.array(*[F.lit(idf.get(w, 0.0)) for w in parts])
            got = F.aggregate(right, F.lit(0.0), lambda s, h: s + F.get(weight, h["p"] - o["at"]))
            return F.round(got / F.lit(total), 6)

        return F.transform(found, lambda o: F.struct(F.lit(label).alias("label"), o["at"].alias("first_word"), share(o).alias("score")))

    places_found = F.concat(*[verified(k, *x) for k, x in enumerate(TEMPLATES)])
    files = files.withColumn("places", F.coalesce(places_found, F.array().cast("array<struct<label:string,first_word:int,score:double>>")))
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("places", lambda p: p["label"]))))
    return files.select(
        F.col("id").alias(id_column),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.when(F.size(places) > 0, 0.5), F.lit(0.0)).alias("score"),
        "places",
    )


def _read(body: DataFrame) -> tuple[DataFrame, int, dict[str, int]]:
    """(stored files, how many, in how many of them each looked-up word stands).

    A file is read once: id, number of words, and, where one of the GATES stands, the places of all template
    words (else none).  The counts go over all files; at most one row for each word comes back.
    """
    words = F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(WORD), F.lit(0))
    may_hold = reduce(lambda a, b: a | b, [F.lower("t").contains(x) for x in GATES])

    def of_words(ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda h: h["w"].isin(_vocabulary()))
        held = F.array_distinct(F.filter(ws, lambda w: w.isin(_looked_up())))
        return F.struct(F.size(ws).cast("long").alias("n_words"), held.alias("held"), F.when(may_hold, hits).otherwise(F.array().cast("array<struct<p:int,w:string>>")).alias("hits"))

    files, _ = staged(body.select("id", let(words, of_words).alias("f")).select("id", "f.*"), "files")
    rows = files.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return files, counts.pop("", 0), counts
