"""Licence notices in texts: fixed phrases, and an exact set-similarity join with templates.

Base: the places where a phrase's words stand consecutively.

Method: a block is a stretch of a text, as the set of its words. With ``n`` twice the words
of the longest template, the stretches are the windows of ``2 n`` words that start at every
``n``-th word, and the lines of up to ``2 n`` words. So a notice spread over at most ``n``
words is compared whole, wherever line feeds stand, and words scattered over more than
``2 n`` words of a text do not make up a notice. A template matches a block that holds at
least ``containment`` of the template's words, whatever their order and whatever stands
between. The join is exact:

1. One pass turns every block into the set of its words that occur in any template; no
   other word can count. Blocks with fewer such words than the easiest template needs
   are gone (length filter).
2. Template words are ordered by how many blocks hold them over the whole corpus,
   rarest first.
3. A template that needs ``o`` of its ``t`` words meets a block within the first
   ``t - o + 1`` of them. Blocks enter with the words that can be such a first meeting,
   and join the templates on that word (prefix filter).
4. The meeting place bounds the overlap from above: what is left of either set after it
   must suffice (positional filter). Pairs that pass are counted in full.

Templates are a parameter held by the program, so their side of every join is a few
hundred rows and is broadcast.

Rows: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
``labels``, ``score``: the largest containment among matches, 1.0 where a base phrase
stands, else 0. A null text is empty. Rows are judged one by one, so repeated and null ids
are fine. An empty table gives an empty result; further columns are ignored. Built-in
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.session import written

CONTAINMENT = 0.85

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and words of each notice.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("copyright", "copyright all rights reserved no part of this publication may be reproduced"),
]

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z folded only: ``lower`` where the text is ASCII, letter by letter otherwise."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def _phrase_places(padded: Column, phrase: str) -> Column:
    """Struct (n, first, last): where ``phrase`` starts in a text whose words stand between single spaces."""
    parts = F.split(padded, f"(?<= ){phrase}(?= )")
    step = len(phrase.split())
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("first"), none.alias("last"))
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) - 1
    walked = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), start,
        lambda a, x: F.struct(
            (a["n"] + 1).alias("n"), F.coalesce(a["first"], words(x).cast("long")).alias("first"),
            F.coalesce(a["last"] + step + words(x), words(x).cast("long")).alias("last"),
        ),
    )
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), walked).otherwise(start)


def _literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of the parameter's rows, written into the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    structs = [F.struct(*[lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    table = F.array(*structs) if structs else F.array().cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    return F.broadcast(spark.range(1).select(F.inline(table)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Notices of every row (see the module's notes)."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sets = [(i, label, sorted(set(words.split()))) for i, (label, words) in enumerate(templates)]
    need = {i: max(1, math.ceil(round(containment * len(words), 9))) for i, _, words in sets}
    vocabulary = sorted({w for _, _, words in sets for w in words})
    least = min(need.values(), default=1)

    text = lowered(F.coalesce("text", F.lit("")))
    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    n = 2 * max((len(words.split()) for _, words in templates), default=1)
    words_of = lambda x: F.filter(F.split(x, _GAP), lambda w: w != "")
    shared_of = lambda x: F.array_intersect(x, known) if vocabulary else F.array().cast("array<string>")
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _GAP, " ")), F.lit(" "))
    parts = docs.select(F.col("doc_id").cast("long"), text.alias("text"), padded.alias("padded"), F.split(F.trim(padded), " ").alias("ws"))
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ws") - n, F.lit(1)), F.lit(n)), lambda i: shared_of(F.slice("ws", i, 2 * n))
    )
    # A line of up to n words lies in a window.
    lines = F.filter(F.transform(F.split("text", "\n"), words_of), lambda x: (F.size(x) > n) & (F.size(x) <= 2 * n))
    blocks = F.filter(F.concat(windows, F.transform(lines, shared_of)), lambda b: F.size(b) >= least)
    read = parts.select("doc_id", blocks.alias("blocks"), "padded")
    places = read.select(
        "doc_id", "blocks",
        F.when(F.col("padded") == "  ", F.lit(0)).otherwise(
            F.length("padded") - F.length(F.replace("padded", F.lit(" "), F.lit(""))) - 1
        ).cast("long").alias("n_words"),
        *[_phrase_places(F.col("padded"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)],
    )
    # The row number is fixed by being written.
    held = written(places.withColumn("uid", F.monotonically_increasing_id()), "licence-blocks")

    exploded = held.where(F.size("blocks") > 0).select("uid", F.posexplode("blocks").alias("block", "words"))
    counted = exploded.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    order = {r["word"]: r["f"] for r in counted.collect()}  # no more rows than the templates have words
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (order.get(w, 0), w)))}
    firsts, members = [], []
    for i, label, words in sets:
        ordered = sorted(words, key=rank.get)
        members.append((i, label, ordered, need[i], len(ordered)))
        firsts += [(w, i, len(ordered) - at) for at, w in enumerate(ordered[: len(ordered) - need[i] + 1])]
    ranks = _literal_table(spark, list(rank.items()), "word string, rank int")
    prefix = _literal_table(spark, firsts, "word string, template int, rest_t int")
    whole = _literal_table(spark, members, "template int, label string, members array<string>, need int, t int")

    ordered = exploded.select("uid", "block", F.explode("words").alias("word")).join(ranks, "word").groupBy("uid", "block").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ws")
    )
    entered = ordered.select("uid", "block", "ws", F.posexplode(F.slice("ws", F.lit(1), F.size("ws") - (least - 1))).alias("at", "w"))
    met = entered.select("uid", "block", F.transform("ws", lambda w: w["word"]).alias("ws"), (F.size("ws") - F.col("at")).alias("rest_b"), F.col("w.word").alias("word"))
    pairs = met.join(prefix, "word").join(whole, "template").where(F.least("rest_b", "rest_t") >= F.col("need"))
    shared = F.size(F.array_intersect("ws", "members"))
    matched = pairs.where(shared >= F.col("need")).select("uid", "label", (shared / F.col("t")).alias("share"))
    best = matched.groupBy("uid").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    names = list(PHRASES.values())
    spots = F.array(*[F.col(f"p{i}") for i in range(len(names))])
    base = F.filter(F.array(*[F.when(F.col(f"p{i}.n") > 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    out = held.drop("blocks").join(best, "uid", "left").select(
        "doc_id", "n_words", F.aggregate(spots["n"], F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_min(spots["first"]).alias("first_word"), F.array_max(spots["last"]).alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base"),
        F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("share", F.lit(0.0)).alias("share"),
    )
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("share")), 6).alias("score"),
    )
