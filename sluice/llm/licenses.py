"""License scan: exact containment join of text blocks with license templates, DataFrame functions only.

Templates are whole notices, as sets of lower-cased words.  Blocks are overlapping windows of a text's words, across
line feeds, in a few sizes: every notice of up to `longest` words of a size lies whole in some block of that size, and a
block is not much longer than its notices, so scattered words do not add up to one.  A block matches a template when
it holds at least `threshold` of the template's words, among them the words that name the license, and no template
that matches the same block holds all words of this one and more (a CC BY-NC notice is not also CC BY).

The join is exact: template words are ordered by their frequency over all texts (rarest first, ties by word), a
template is indexed under its first size - needed + 1 words only, blocks are made only around places of such words,
and candidates must pass the length filter (enough template words in the block) and the positional filter (enough
words left after the first place where the two met) before they are verified.  Besides, fixed phrases are located word
by word; they give the base labels.

Defined cases: a null or wordless text has no words, places or labels (first and last word null, score 0); texts of any
length are read whole; templates that tie in a block all count; repeated rows get equal results; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, sized, written

THRESHOLD = 0.8
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Customary license notices: label, the words that name it, the notice.
TEMPLATES = [
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "gnu 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd-3", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0"),
    ("all-rights-reserved", "reserved", "Copyright. All rights reserved"),
]
#: The most words of a notice, and the words of a block, size by size; blocks start every block - longest + 1 words.
SIZES = [(8, 10), (16, 20), (32, 40), (80, 100)]


def words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _phrase_places(tokens: Column, phrase: str) -> Column:
    parts = phrase.split()
    # the first word alone rules out almost every place; get() gives null past the end
    return F.filter(
        F.transform(tokens, lambda w, i: F.when(w == parts[0], i)),
        lambda i: i.isNotNull() & F.concat_ws(" ", F.slice(tokens, i + 1, len(parts))).eqNullSafe(phrase),
    )


def size_of(template: str) -> int:
    """The number of the smallest size that a template's words fit."""
    n = len(words(template))
    fitting = [k for k, (longest, _) in enumerate(SIZES) if n <= longest]
    if not fitting:
        raise ValueError(f"a template has {n} words, more than {SIZES[-1][0]}")
    return fitting[0]


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, places (all phrase starts), base_labels, labels (both sorted arrays), score.

    score is 1 where a phrase stands, else the largest containment among the matched templates, else 0.
    """
    sets = [(label, frozenset(words(naming)), frozenset(words(t)), size_of(t)) for label, naming, t in templates]
    vocabulary = sorted(set().union(*(s for _, _, s, _ in sets)))
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = docs.select("doc_id", F.trim(F.regexp_replace(ascii_lower(text), _GAP, " ")).alias("line"))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "))) + 1).cast("long").alias("n_words")
    tokens = F.split("line", " ")
    found = []
    for phrase, label in phrases.items():
        stands = F.contains(F.concat(F.lit(" "), "line", F.lit(" ")), F.lit(f" {phrase} "))
        bound = F.flatten(F.transform(F.array(tokens), lambda t: _phrase_places(t, phrase)))
        found.append(F.when(stands, bound).otherwise(F.array().cast("array<int>")).alias(f"at_{label}"))
    # places of template words alone are kept: block and word of each
    held = F.filter(F.transform(tokens, lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    rows = written(spaced.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words, held.alias("held"), *found), "blocks")

    # at most one row for each template word comes back
    count = {r["w"]: r["count"] for r in rows.select(F.explode("held.w").alias("w")).groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    spark = docs.sparkSession
    index = []
    for number, (label, naming, s, k) in enumerate(sets):
        ordered = sorted(s, key=rank.__getitem__)
        needed = math.ceil(threshold * len(s) - 1e-9)
        wider = [m for m, (_, _, other, size) in enumerate(sets) if size == k and s < other]
        index += [(w, number, label, k, i, len(s), needed, ordered, sorted(naming), wider) for i, w in enumerate(ordered[: len(s) - needed + 1])]
    index = spark.createDataFrame(index, "w string, number int, label string, k int, i int, size int, needed int, whole array<string>, naming array<string>, wider array<int>")
    # blocks around the places of indexed words; a row with none goes no further
    lengths, steps = (F.array(*(F.lit(x) for x in xs)) for xs in ([b for _, b in SIZES], [b - longest + 1 for longest, b in SIZES]))
    length, step = F.element_at(lengths, F.col("k") + 1), F.element_at(steps, F.col("k") + 1)
    first, last = F.ceil(F.greatest(F.lit(0), F.col("at") - length + 1) / step).cast("int"), F.floor(F.col("at") / step).cast("int")
    around = lambda source: source.withColumns({"block": F.explode(F.sequence(first, last))})
    sought = sorted({(r["w"], r["k"]) for r in index.select("w", "k").collect()})
    places = rows.select("row", F.explode(F.filter("held", lambda x: x["w"].isin(*sorted({w for w, _ in sought})))).alias("x")).select("row", F.col("x.i").alias("at"), F.col("x.w").alias("w"))
    blocks = written(around(places.join(F.broadcast(index.select("w", "k").distinct()), "w")).select("row", "k", "block").distinct(), "places")
    kinds = blocks.groupBy("row").agg(F.array_sort(F.collect_set("k")).alias("kinds"))  # at most one entry for each size
    every = rows.select("row", "held").join(sized(kinds, 64 * kinds.count()), "row").select("row", F.explode("kinds").alias("k"), "held").select("row", "k", F.inline("held")).withColumnRenamed("i", "at")
    vocabularies = F.array(*(F.array(*(F.lit(w) for w in sorted(set().union(*(s for _, _, s, size in sets if size == k), {""})))) for k in range(len(SIZES))))
    every = around(every.where(F.array_contains(F.element_at(vocabularies, F.col("k") + 1), F.col("w"))))
    ranks = spark.createDataFrame(list(rank.items()), "w string, rank int")
    block = ["row", "k", "block"]
    gathered = every.join(sized(blocks, 32 * blocks.count()), block, "left_semi").join(F.broadcast(ranks), "w")
    gathered = gathered.groupBy(*block).agg(F.transform(F.array_sort(F.collect_set(F.struct("rank", "w"))), lambda x: x["w"]).alias("held"))
    met = (
        gathered.select(*block, "held", F.posexplode("held").alias("j", "w"))
        .join(F.broadcast(index), ["w", "k"])
        .where(F.size("held") >= F.col("needed"))
        .where(F.least("i", "j") + 1 + F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) - 1 >= F.col("needed"))
    )
    share = F.size(F.array_intersect("held", "whole"))
    good = met.where((share >= F.col("needed")) & (F.size(F.array_except("naming", "held")) == 0))
    good = good.groupBy(*block).agg(F.collect_set(F.struct("number", "label", "wider", (share / F.col("size")).alias("share"))).alias("met"))
    numbers = F.transform("met", lambda x: x["number"])
    good = good.select("row", F.explode(F.filter("met", lambda x: ~F.arrays_overlap(x["wider"], numbers))).alias("x"))
    matched = good.groupBy("row").agg(F.collect_set("x.label").alias("more"), F.max("x.share").alias("best"))
    all_places = F.array_sort(F.concat(*(F.col(f"at_{label}") for label in phrases.values())))
    base = F.array_sort(F.filter(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in phrases.values())), lambda x: x.isNotNull()))
    return rows.join(matched, "row", "left").select(
        "doc_id",
        "n_words",
        all_places.alias("places"),
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
