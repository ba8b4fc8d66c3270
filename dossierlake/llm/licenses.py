"""License scan: Dice coefficient over word bigrams against license templates; DataFrame functions only.

Every stretch of a text's words may be a notice: wrapped over lines, within a paragraph, with words added or lost. The best
stretch begins and ends with a bigram of the template, as others only lower the coefficient. Size bounds prune:
a Dice coefficient of ``t`` needs the smaller set to have ``t / (2 - t)`` of the larger one's size, so a stretch
has no more words than that and holds so many of the template's bigrams. Texts without any anchor word are pruned first: a
template's anchors are so chosen that bigrams without them are too few to reach ``t``. Around an anchor word, as far as
half the template reaches beyond where the template would stand, the stretches between matching bigrams are weighed, all of them by a
bound of their coefficient, and exactly unless the bound is below what another has.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Wordings of well-known licenses and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def anchors(grams: set[str], threshold: float = THRESHOLD) -> list[str]:
    """Words of which any set that reaches the threshold has one."""
    needed = ceil(threshold / (2 - threshold) * len(grams) - 1e-9)  # the overlap that the smallest partner has
    chosen: list[str] = []
    left = set(grams)
    while len(left) >= needed and left:
        count: dict[str, int] = {}
        for g in left:
            for w in set(g.split(" ")):
                count[w] = count.get(w, 0) + 1
        word = max(count, key=lambda w: (len(w) ** 2 * count[w], w))
        chosen.append(word)
        left = {g for g in left if word not in g.split(" ")}
    return chosen


def places(text: str) -> list[tuple[str, int]]:
    """(anchor, its place in the template's words from 0) of a template, every place of each."""
    chosen = anchors(bigrams_of(text))
    return [(w, i) for i, w in enumerate(words_of(text)) if w in chosen]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _plain(text: Column) -> Column:
    """The words of a text, in lower case, with one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Best license of every text: doc_id, license, dice (the best coefficient of any stretch), n_licenses (that reach the threshold).

    Ties go to the license first in name order. Null, empty and unlicensed texts have a null license, dice 0 and n_licenses 0.
    Texts of any length are scanned whole. Repeated rows stay repeated, null doc_ids stay null, further columns are
    ignored, whatever their names; no rows from no rows.
    """
    wordings = dict(sorted((templates or TEMPLATES).items()))
    low = threshold / (2 - threshold)
    grams = {k: sorted(bigrams_of(v)) for k, v in wordings.items()}
    words = sorted({a for g in grams.values() for a in anchors(set(g), threshold)})
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    entries = F.array(*[
        F.struct(
            F.lit(a).alias("word"), F.lit(i).alias("at"), F.lit(len(words_of(wordings[name]))).alias("size"), F.lit(name).alias("license"),
            F.lit(ceil(low * len(grams[name]) - 1e-9)).alias("least"), F.array(*map(F.lit, grams[name])).alias("grams"),
        ) for name in wordings for a, i in places(wordings[name])
    ])

    def distinct(stretch: Column) -> Column:
        """Distinct bigrams of words."""
        n = F.size(stretch)
        return F.array_distinct(F.zip_with(F.slice(stretch, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(stretch, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))

    def exact(region: Column, e: Column, pair: Column) -> Column:
        own = distinct(F.slice(region, pair["a"] + 1, pair["b"] - pair["a"] + 2))
        return F.struct(_let(own, lambda g: F.lit(2.0) * F.size(F.array_intersect(g, e["grams"])) / (F.size(g) + F.size(e["grams"]))).alias("dice"), e["license"].alias("license"))

    def stretches(region: Column, e: Column, at: Column) -> Column:
        """The best stretch from one matching bigram to another, if it reaches the threshold.

        A stretch has at most as many matches as places that match, and at least as many distinct bigrams as places, less those
        of the region that repeat one. In falling order of the bound that this gives, stretches are compared exactly until none can be better.
        """
        size = F.size(e["grams"])
        repeated = F.size(region) - 1 - F.size(distinct(region))

        def bounded(again: Column) -> Column:
            pairs = F.flatten(F.transform(at, lambda a, i: F.transform(
                F.slice(at, i + 1, F.size(at)), lambda b, j: F.struct((F.lit(2.0) * (j + 1) / (F.greatest(b - a + 1 - again, F.lit(1)) + size)).alias("d"), a.alias("a"), b.alias("b"))
            )))
            return F.sort_array(F.filter(pairs, lambda x: x["d"] >= threshold), False)

        start = F.struct(F.lit(0.0).alias("dice"), e["license"].alias("license"))
        better = lambda s, x: F.when(x["d"] > s["dice"], _let(exact(region, e, x), lambda y: F.when(y["dice"] > s["dice"], y).otherwise(s))).otherwise(s)
        best = F.aggregate(_let(repeated, bounded), start, better)
        return F.filter(F.array(best), lambda x: x["dice"] >= threshold)

    def around(ws: Column, h: Column, e: Column) -> Column:
        reach = F.floor(e["size"] / 2).cast("int")
        region = F.slice(ws, F.greatest(h["i"] - e["at"] - reach, F.lit(0)) + 1, e["size"] + 2 * reach)
        matching = lambda r: F.filter(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), lambda j: F.array_contains(e["grams"], F.concat_ws(" ", F.get(r, j), F.get(r, j + 1))))
        none = F.array().cast("array<struct<dice:double,license:string>>")
        return _let(region, lambda r: _let(matching(r), lambda at: F.when(F.size(at) >= e["least"], stretches(r, e, at)).otherwise(none)))

    def found(ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: x["word"].isin(*words))
        return F.flatten(F.transform(hits, lambda h: F.flatten(F.transform(F.filter(entries, lambda e: e["word"] == h["word"]), lambda e: around(ws, h, e)))))

    none = F.array().cast("array<struct<dice:double,license:string>>")
    # what a text with a sign of another script between letters spells is no word boundary; stretches decide
    hits = F.when(F.lower("text").rlike("|".join(words)), _let(F.split(_plain(F.col("text")), " "), found)).otherwise(none)
    best = F.aggregate("hits", F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("license")), lambda s, x: F.when(
        (x["dice"] > s["dice"]) | ((x["dice"] == s["dice"]) & (x["license"] < s["license"])), x
    ).otherwise(s))
    kinds = F.size(F.array_distinct(F.transform("hits", lambda x: x["license"]))).cast("long")
    top = rows.select("doc_id", hits.alias("hits")).select("doc_id", best.alias("best"), kinds.alias("n_licenses"))
    return top.select("doc_id", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), "n_licenses")
