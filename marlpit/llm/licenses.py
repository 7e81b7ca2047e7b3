"""License scans by an exact set-similarity join with templates.

A text block is a window of 2 * s words, every s words: any run of up to s + 1 words lies in
some block whole. The stride s is ``STRIDE`` or, for longer templates, the power of two from
which on a template lies in a block whole; so short notices have short blocks and whole
license texts long ones. A block meets a template if it holds at
least ``threshold`` of the template's different words. The join is exact and filters
pairs by

* prefix: words are ordered by their frequency in the whole corpus, rarest first; a block
  that meets a template of n words, m of them needed, holds one of its n - m + 1 rarest;
* length: a block with fewer than m template words can't meet it;
* position: after the first shared word at place i of the template and j of the block,
  at most min(n - i, size - j) - 1 more can follow.

What passes is verified against the template's words, which lie in a table of their own: an index row
has only numbers. Both tables are parameters; up to ``BROADCAST_CHARS`` characters they are broadcast, beyond that
Spark chooses the join. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import LOWER, UPPER

#: What separates words once letters are in lower case.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACES, _BLOCKS = "array<struct<at:bigint,label:string>>", "array<struct<at:bigint,stride:int,tokens:array<string>>>"
STRIDE, THRESHOLD = 32, 0.8
BROADCAST_CHARS = 1 << 25

#: Phrases that count wherever their words stand consecutively.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Opening sentences and short notices of public licenses, in lower case without punctuation.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.array_remove(F.split(text, _GAP), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def stride_of(template: str) -> int:
    """Words from block to block for a template."""
    return max(STRIDE, 1 << (len(template.split()) - 2).bit_length())


def frequency_order(rows: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary by the number of rows whose ``words`` hold it, rarest first, then by name."""
    held = rows.select(F.explode(F.array_intersect(_strings(vocabulary), F.col("words"))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in held.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, n_words, n_base, first_word, last_word, base_labels, found and score.

    ``found`` holds the matches (label, block, containment) of the join, block being its first word; n_base counts the
    places of ``phrases``, first_word and last_word are their smallest and largest start.
    ``score`` is 1 with a phrase, else the largest containment found, else 0. A null text
    counts as empty. Texts of any length are scanned whole. Rows that repeat are scanned each by
    itself; of equally good matches all count; an empty table gives no rows. Only the two named
    columns are read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # lower() may turn a letter beyond ASCII into an ASCII one, never the other way, so it only finds more candidates
    rows = rows.select("id", "text", words(F.lower("text")).alias("words"))
    sets = [(label, sorted(set(text.split())), stride_of(text)) for label, text in templates]
    rank = {w: i for i, w in enumerate(frequency_order(rows, sorted({w for _, ws, _ in sets for w in ws} | {w for p, _ in phrases for w in p.split()})))}
    order = [w for w in rank if any(w in ws for _, ws, _ in sets)]
    index, rare = [], set()
    owns = []
    for t, (label, own, stride) in enumerate(sets):
        own = sorted(own, key=rank.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        for i, word in enumerate(own[: len(own) - need + 1]):
            index.append((word, stride, t, i, need, len(own)))
            rare.add(word)
        owns.append((t, label, own))
    least = {stride: min(x[4] for x in index if x[1] == stride) for _, _, stride in sets}

    exact = words(F.translate("text", UPPER, LOWER))
    marks = sorted({min(p.split(), key=rank.__getitem__) for p, _ in phrases})
    sized = F.size("words")

    def blocks_of(stride: int) -> Column:
        known = [w for w in order if any(w in ws for _, ws, s in sets if s == stride)]
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((sized - stride - 1) / stride).cast("int")) * stride, F.lit(stride))
        held = F.transform(starts, lambda at: F.struct(at, F.lit(stride), F.array_intersect(_strings(known), F.slice("words", at + 1, 2 * stride)))).cast(_BLOCKS)
        return F.filter(held, lambda b: F.size(b["tokens"]) >= least[stride])

    blocks = F.concat(*(blocks_of(stride) for stride in sorted(least))) if least else F.array().cast(_BLOCKS)
    held = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", sized.cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", _strings(marks)), exact).alias("exact"),
        F.when(F.arrays_overlap("words", _strings(sorted(rare))), blocks).alias("blocks"),
    )
    places = [_places(phrase.split(), label) for phrase, label in phrases]
    none = F.array().cast(_PLACES)
    held = held.select("row", "id", "n_words", F.concat(*(F.coalesce(p, none) for p in places)).alias("base") if places else none.alias("base"), F.explode_outer("blocks").alias("b"))
    shared = held.select("row", "id", "n_words", "base", "b.at", "b.stride", "b.tokens", F.explode_outer(F.array_intersect("b.tokens", _strings(sorted(rare)))).alias("word"))
    small = sum(len(w) + 24 for w, *_ in index) + sum(len(w) + 8 for _, _, own in owns for w in own) <= BROADCAST_CHARS
    near = F.broadcast if small else lambda df: df
    spark = docs.sparkSession
    met = shared.join(near(spark.createDataFrame(index, "word string, stride int, t int, i int, need int, n int")), ["word", "stride"], "left")
    j = F.array_position("tokens", F.col("word")) - 1
    possible = (F.size("tokens") >= F.col("need")) & (F.col("i") + F.least(F.col("n") - F.col("i"), F.size("tokens") - j) >= F.col("need"))
    met = met.withColumn("t", F.when(possible, F.col("t"))).join(near(spark.createDataFrame(owns, "t int, label string, own array<string>")), "t", "left")
    both = F.size(F.array_intersect("tokens", "own"))
    hit = F.when(both >= F.col("need"), F.struct("label", F.col("at").alias("block"), (both / F.col("n")).alias("containment")))
    found = met.select("row", "id", "n_words", "base", hit.alias("hit")).groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("base").alias("base"), F.array_sort(F.collect_set("hit")).alias("found"))
    at = F.transform("base", lambda p: p["at"])
    return found.select(
        F.col("id").alias(id_column), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        _labels(F.transform("base", lambda p: p["label"])).alias("base_labels"), _labels(F.concat(F.transform("base", lambda p: p["label"]), F.transform("found", lambda h: h["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda h: h["containment"])), F.lit(0.0))).alias("score"), "found",
    )


def _places(parts: list[str], label: str) -> Column:
    """(at, label) of each place in ``exact`` where the words stand one after the other."""
    run = F.sequence(F.lit(0), F.size("exact") - len(parts))
    at = F.filter(run, lambda i: F.slice("exact", i + 1, len(parts)) == _strings(parts))
    return F.when(F.size("exact") >= len(parts), F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))).cast(_PLACES))


def _labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
