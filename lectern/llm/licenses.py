"""Operator 5: licence scans by a positional rare-token index.

Native: DataFrame functions only. One pass over the texts finds each row's
licence words (words of the templates, function words aside) with their
places, and the places of the fixed phrases. Document frequencies of the
licence words over the whole corpus give their IDF. In rows where a mandatory
phrase stands, the words that are rare in a template propose the places where
it would start: its highest-IDF words, so many that the others together stay
below the least share, so that no place that reaches it goes unproposed. A
proposal is a candidate once the mandatory phrase stands at that very place.
All licence words of the row then vote for the candidates by relative
position; one counts with enough different words and share of the weight.

Counts of words combine per task before they move; a row's votes are grouped
by row. Only the licence words' IDF (at most as many as the templates have
words) comes to the driver.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows each get their own result. The score is 1 where a fixed phrase
of ``BASE`` stands, else the best candidate's share of its template's weight.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Phrases and the labels they stand for.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages of public licences, each with the phrase that
# must stand in it.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files", "permission is hereby granted free of charge"),
    "apache-2": ("licensed under the apache license version 2 0 you may not use this file except in compliance"
                 " with the license", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met", "redistribution and use in source and binary forms"),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu"
            " general public license as published by the free software foundation", "gnu general public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is"
            " hereby granted", "permission to use copy modify and or distribute"),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",
              "mozilla public license v 2 0"),
    "cc-by-nc": ("this work is licensed under the creative commons attribution noncommercial license",
                 "creative commons attribution noncommercial"),
}
_FUNCTION_WORDS = frozenset("a an and any are as by can for form forms in is it may not of on or that the this to use with you v 0 2".split())

#: Different words that must agree on a place, and the share of the template's
#: weight they must reach.
AGREE = 3
LEAST_SHARE = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOCABULARY = sorted({w for t, _ in TEMPLATES.values() for w in t.split()} - _FUNCTION_WORDS)
#: (phrase, its words, its label if a base phrase); the mandatory ones follow.
PHRASES = [(p, p.split(), label) for p, label in BASE.items()] + [(p, p.split(), None) for _, p in TEMPLATES.values()]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` maps two other letters into ASCII; only
    texts that hold one of them take the slow way."""
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively. Only rows with all of
    its words look; they try the places of its rarest-looking word."""
    anchor = max(range(len(phrase)), key=lambda i: (phrase[i] not in _FUNCTION_WORDS, len(phrase[i])))
    here = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[anchor], i - anchor)), lambda i: i >= 0)
    n = len(phrase)
    fits = F.filter(here, lambda i: F.slice(words, i + 1, n) == F.array(*map(F.lit, phrase)))
    has = F.lit(True)
    for w in sorted(set(phrase) - _FUNCTION_WORDS or set(phrase)):
        has = has & F.array_contains(words, w)
    return F.when(has, F.transform(fits, lambda i: i.cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))


def index(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """One row each: ``row, keep, n_words, phrases`` (places of each of
    ``PHRASES``) and ``found`` (licence words with their places)."""
    tokens = docs.select(F.struct(*(docs[c].alias(c) for c in keep)).alias("keep"), F.regexp_extract_all(
        lower_ascii(F.coalesce(docs[text_col], F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    words = F.col("words")
    found = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(VOCABULARY))
    none = F.expr("cast(array() as array<struct<word:string,at:int>>)")
    empty = F.expr("cast(array() as array<array<bigint>>)")
    signal = F.arrays_overlap(words, vocabulary)
    outside = [w for _, p, label in PHRASES if label for w in p if w not in VOCABULARY and w not in _FUNCTION_WORDS]
    any_sign = F.arrays_overlap(words, F.array(*map(F.lit, VOCABULARY + sorted(set(outside)))))
    return tokens.select(
        F.monotonically_increasing_id().alias("row"), "keep", F.size("words").cast("long").alias("n_words"),
        F.when(any_sign, F.array(*(_places(words, p) for _, p, _ in PHRASES))).otherwise(empty).alias("phrases"),
        F.when(signal, found).otherwise(none).alias("found"))


def _idf(rows: DataFrame) -> dict[str, float]:
    """Over all rows; a word that no row has keeps the highest value."""
    each = rows.select(F.explode(F.array_distinct(F.col("found.word"))).alias("word"))
    df = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = rows.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in VOCABULARY}


def _candidates(rows: DataFrame, idf: dict[str, float]) -> DataFrame:
    """``row, label, share`` of every verified template."""
    ranked = F.create_map(*(F.lit(x) for w in VOCABULARY for x in (w, idf[w])))
    # Added up as the shares are, so that a whole template has share 1.
    weight = {t: reduce(lambda s, w: s + idf[w], sorted(set(text.split()) & idf.keys()), 0.0) for t, (text, _) in TEMPLATES.items()}
    must = {t: (len(BASE) + i, _offset(text.split(), p.split())) for i, (t, (text, p)) in enumerate(TEMPLATES.items())}
    which = F.create_map(*(F.lit(x) for t in must for x in (t, must[t][0])))
    offset = F.create_map(*(F.lit(x) for t in must for x in (t, must[t][1])))

    def votes(rows: DataFrame, words: dict[str, set[str]]) -> DataFrame:
        """``row, word, label, start`` for each licence word of the rows and
        each place of it in the templates that take it from ``words``."""
        postings: dict[str, list[tuple[str, int]]] = {}
        for label, (text, _) in TEMPLATES.items():
            for at, w in enumerate(text.split()):
                if w in words[label]:
                    postings.setdefault(w, []).append((label, at))
        places = F.create_map(*(x for w in postings for x in (F.lit(w), F.array(*(
            F.struct(F.lit(t).alias("label"), F.lit(at).alias("at")) for t, at in postings[w])))))
        hits = rows.select("row", F.explode(F.filter("found", lambda x: x["word"].isin(sorted(postings)))).alias("f"))
        each = hits.select("row", "f.word", (F.lit(0) + F.col("f.at")).alias("at"), F.explode(places[F.col("f.word")]).alias("p"))
        return each.select("row", "word", F.col("p.label").alias("label"), (F.col("at") - F.col("p.at")).alias("start"))

    stands = F.exists(F.slice("phrases", len(BASE) + 1, len(TEMPLATES)), lambda x: F.size(x) > 0)
    some = rows.filter((F.size("found") >= AGREE) & stands)
    proposed = votes(some, {t: _rare(t, idf) for t in TEMPLATES}).select("row", "label", "start").distinct()
    candidates = proposed.join(some.select("row", "phrases"), "row").filter(F.array_contains(
        F.get("phrases", which[F.col("label")]), (F.col("start") + offset[F.col("label")]).cast("long"))).select("row", "label", "start")
    every = votes(some, {t: set(text.split()) & idf.keys() for t, (text, _) in TEMPLATES.items()})
    placed = (every.join(candidates, ["row", "label", "start"], "left_semi").groupBy("row", "label", "start")
              .agg(F.collect_set("word").alias("words")).filter(F.size("words") >= AGREE))
    total = F.create_map(*(F.lit(x) for t in weight for x in (t, weight[t])))
    share = F.aggregate(F.array_sort("words"), F.lit(0.0), lambda s, w: s + ranked[w]) / total[F.col("label")]
    good = placed.withColumn("share", F.least(share, F.lit(1.0))).filter(F.col("share") >= LEAST_SHARE)
    return good.groupBy("row", "label").agg(F.max("share").alias("share"))


def _rare(label: str, idf: dict[str, float]) -> set[str]:
    """The template's rarest licence words, so many that the rest of them
    weigh less than the least share (and a little, for rounding)."""
    own = sorted(set(TEMPLATES[label][0].split()) & idf.keys(), key=lambda w: (-idf[w], w))
    rest, n = sum(idf[w] for w in own), 0
    least = LEAST_SHARE * rest * (1 - 1e-9)
    while rest >= least:
        rest -= idf[own[n]]
        n += 1
    return set(own[:n])


def _offset(text: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(text)) if text[i:i + len(phrase)] == phrase)


def scan(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """For every row: ``keep``, ``n_words``, ``base`` (sorted
    ``struct<at long, label string, size int>`` of the places of the base
    phrases), ``labels`` (sorted, with the method's) and ``score``."""
    rows = stored(index(docs, text_col, keep), "licences")
    idf = _idf(rows)
    added = _candidates(rows, idf).groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    def placed(i, label, size):
        at = F.coalesce(F.get("phrases", F.lit(i)), F.expr("cast(array() as array<bigint>)"))
        return F.transform(at, lambda x: F.struct(x.alias("at"), F.lit(label).alias("label"), F.lit(size).alias("size")))

    base = F.flatten(F.array(*(placed(i, label, len(words)) for i, (_, words, label) in enumerate(PHRASES) if label)))
    out = rows.join(added, "row", "left").withColumn("base", F.array_sort(base))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.coalesce("added", F.expr("cast(array() as array<string>)")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("row", "keep", "n_words", "base", labels.alias("labels"), score.alias("score"))
