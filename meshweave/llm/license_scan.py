"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts become words (letters and digits, lower case) and hashed five-word shingles.
Templates fall into classes by length, powers of two c; a text is cut into windows of 2c
words that start every c words, so a template of up to c words lies whole in a window.
The least Jaccard similarity that a template contained to 0.8, or whole, can have with a
window follows from its number of shingles and the window's; each class has as many bands
of one MinHash value, BANDS at least, as retrieve each of its templates with a probability
over 1 - MISS, and, if whole, over 1 - MISS_WHOLE. A template of a single shingle would
need very many, and is met by that shingle itself, surely. What the bands retrieve is
verified by the exact share of the template's shingles in the window.

Only DataFrame functions are used. Texts that lack every word of a set chosen so that no
template can be contained without them are passed over before any shingle is made.

Defined cases: null and empty texts, and texts under five words, match nothing and give
no row. Each matching row of the input gives rows of its own, so repeated rows repeat. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
CONTAINED = 80  # percent
BANDS = 48
MISS, MISS_WHOLE = 1e-4, 1e-6
MOST_BANDS = 256

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def needed_words(templates: dict[str, list[str]]) -> list[str]:
    """Words such that a text without any of them contains no template to CONTAINED."""
    chosen: set[str] = set()
    for text in (t for ts in templates.values() for t in ts):
        words = words_of(text)
        shingles = {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}
        left = {s for s in shingles if not chosen & set(s)}
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if 100 * len(left) < CONTAINED * len(shingles):
                break
            chosen.add(w)
            left = {s for s in left if w not in s}
    return sorted(chosen)


def _class(n: int) -> int:
    c = 8
    while c < n:
        c *= 2
    return c


def miss(shingles: int, c: int, bands: int, whole: bool = False) -> float:
    """The largest probability that no band of a window of class c meets a template of so
    many shingles, contained to CONTAINED, or whole: the window is full, and the rest of
    its shingles are distinct."""
    held = shingles if whole else -(-CONTAINED * shingles // 100)
    return 0.0 if shingles == 1 else (1 - held / (2 * c - WORDS + 1 + shingles - held)) ** bands


def bands_of(c: int, shingles: list[int]) -> int:
    """The bands of class c for templates of so many shingles each."""
    bands = BANDS
    for n in shingles:
        for bound, whole in ((MISS, False), (MISS_WHOLE, True)):
            one = miss(n, c, 1, whole)
            if one:
                bands = max(bands, math.ceil(math.log(bound) / math.log(one)))
    if bands > MOST_BANDS:
        raise ValueError(f"templates of class {c} need {bands} bands; {MOST_BANDS} are the most")
    return bands


def _hashes(words: Column) -> Column:
    """Hashed shingles by position; empty where there are fewer words."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - WORDS + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WORDS), " ")))
    return F.when(F.size(words) >= WORDS, every).otherwise(F.array().cast("array<bigint>"))


def _keys(hashes: Column, bands: int, single: bool) -> Column:
    """Structs (band, value): one MinHash value per band, the least of the hashes hashed
    again with the band; with single, also each hash itself as band 0."""
    every = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda i: F.struct(i.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, i))).alias("value")))
    return F.concat(every, F.transform(hashes, lambda h: F.struct(F.lit(0).alias("band"), h.alias("value")))) if single else every


def templates_table(docs: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """Rows (license_id, template, class, shingles) of distinct hashed shingles."""
    rows = [(name, i, " ".join(words_of(t)), _class(len(words_of(t)))) for name, ts in templates.items() for i, t in enumerate(ts)]
    if any(len(r[2].split()) < WORDS for r in rows):
        raise ValueError(f"a template has fewer than {WORDS} words")
    table = docs.sparkSession.createDataFrame(rows, "license_id string, template int, words string, class int")
    return table.select("license_id", "template", "class", F.array_distinct(_hashes(F.split("words", " "))).alias("shingles"))


def _windows(c: int) -> Column:
    """Shingles of the windows of 2c words that start every c words."""
    starts = F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(c))
    return F.transform(starts, lambda i: F.struct(F.lit(c).alias("class"), i.alias("window"), F.slice("hashes", i + 1, 2 * c - WORDS + 1).alias("found")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Rows (columns of keep, row, license_id, template, class, window, contained, of,
    first_word): template shingles found in a window, of how many, from which word on.
    row tells rows of the input apart."""
    known = templates_table(docs, templates)
    sizes = sorted({_class(len(words_of(t))) for ts in templates.values() for t in ts})
    able = docs.where(F.col(text).rlike("(?iu)" + "|".join(needed_words(templates))))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    able = able.select(*keep, F.monotonically_increasing_id().alias("row"), words.alias("words"))
    able = able.withColumn("hashes", _hashes(F.col("words"))).where(F.size("hashes") > 0)
    windows = F.flatten(F.array(*[_windows(c) for c in sizes]))
    cut = able.select(*keep, "row", F.inline(windows))
    shingles = {c: [] for c in sizes}
    for r in known.select("class", F.size("shingles")).collect():  # as many as the templates given
        shingles[r[0]].append(r[1])
    bands = {c: bands_of(c, ns) for c, ns in shingles.items()}

    def keyed(hashes: Column, single: Column | None = None) -> Column:
        out = F.lit(None)
        for c, ns in shingles.items():
            one = _keys(hashes, bands[c], 1 in ns) if single is None else F.when(single, F.array(F.struct(F.lit(0).alias("band"), F.get(hashes, F.lit(0)).alias("value")))).otherwise(_keys(hashes, bands[c], False))
            out = F.when(F.col("class") == c, one).otherwise(out)
        return F.inline(out)

    banded = cut.select("*", keyed(F.col("found")))
    keys = F.broadcast(known.select("*", keyed(F.col("shingles"), F.size("shingles") == 1)))
    met = banded.join(keys, ["class", "band", "value"]).select(*keep, "row", "license_id", "template", "class", "window", "found", "shingles", "band")
    # A window and a template meet in up to all bands of the class; one stands for all.
    contained = F.size(F.array_intersect("found", "shingles"))
    places = F.filter(F.transform("shingles", lambda s: F.array_position("found", s)), lambda p: p > 0)
    told = met.select(*keep, "row", "license_id", "template", "class", "window", contained.alias("contained"), F.size("shingles").alias("of"), (F.col("window") + F.array_min(places) - 1).cast("long").alias("first_word")).where(100 * F.col("contained") >= CONTAINED * F.col("of"))
    return told.distinct()


def licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Rows (key column, license_id, containment, first_word): the best of each license
    in each row of docs that has one."""
    found = scan(docs, text, (key,), templates)
    return found.groupBy(key, "row", "license_id").agg(F.round(F.max(F.col("contained") / F.col("of")), 6).alias("containment"), F.min("first_word").alias("first_word")).drop("row")
