"""Operator 9: licence scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Words are lower-cased ASCII letters and digits, shingles five of them. Templates
are classed by their number of shingles, rounded up to a power of two; a class of
size s reads texts in windows of 2 s shingles, one starting every s, so that each
place where a template can stand lies whole in some window. Bands of one MinHash row retrieve
templates: a window that holds a template's share ``containment`` has a Jaccard similarity to it
above ``lowest_similarity``, and ``bands_for`` takes enough bands to miss it with a probability
below ``MISS``. Each retrieved pair is then decided by exact containment.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
#: Templates are broadcast; more than these are an error.
MAX_TEMPLATES = 10_000

#: Notices that public licences ask for, and whole texts of the short ones.
TEMPLATES = {
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-3-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
        "neighboring rights to this work."),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "gpl-2.0": "either version 2 of the License, or (at your option) any later version",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation"),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "no-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software"),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software."),
}


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def size_class(template: str) -> int:
    """Shingle places of a template, rounded up to a power of two."""
    return 1 << (len(_words(template)) - SHINGLE).bit_length()


def lowest_similarity(template: str, containment: float) -> float:
    """Least Jaccard similarity of a template and a window of its class that holds its share ``containment``."""
    n = len(_shingles(_words(template)))
    held = math.ceil(containment * n)
    return held / (2 * size_class(template) + n - held)


def bands_for(templates: dict[str, str], containment: float) -> dict[int, int]:
    """By class: bands of one row that miss such a window with a probability below ``MISS``."""
    lowest: dict[int, float] = {}
    for t in templates.values():
        lowest[size_class(t)] = min(lowest.get(size_class(t), 1.0), lowest_similarity(t, containment))
    return {s: math.ceil(math.log(MISS) / math.log1p(-min(j, 1 - 1e-9))) for s, j in sorted(lowest.items())}


def guard_words(templates: dict[str, str], containment: float) -> list[str]:
    """Words of which every window that holds a template's share ``containment`` holds one.

    Of each template so many words, the longest first, that the shingles without
    any are too few to make up that share.
    """
    out: list[str] = []
    for text in templates.values():
        words, mine = _words(text), []
        left = _shingles(words)
        most = len(left) - math.ceil(containment * len(left))  # so many may be missing from a window
        for w in sorted(set(words), key=lambda w: (w not in out, -len(w), w)):
            if len(_shingles(words)) - len(left) > most:
                break
            kept = [s for s in left if w not in s.split()]
            if len(kept) < len(left):
                left = kept
                mine.append(w)
        out += [w for w in mine if w not in out]
    return out


def _template_bands(spark: SparkSession, templates: dict[str, str], bands: dict[int, int]) -> DataFrame:
    """(license, size, of array<long>, band, value)"""
    rows = []
    for name, text in templates.items():
        of = F.array(*(F.xxhash64(F.lit(s)) for s in _shingles(_words(text))))
        rows.append(F.struct(F.lit(name).alias("license"), F.lit(size_class(text)).alias("size"), of.alias("of")))
    one = spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return one.select("license", "size", "of", F.posexplode(_minhashes(F.col("of"), F.col("size"), bands)).alias("band", "value"))


def _minhashes(shingles: Column, size: Column, bands: dict[int, int]) -> Column:
    """One MinHash for each band of the class."""
    n = F.lit(0)
    for s, k in bands.items():
        n = F.when(size == s, k).otherwise(n)
    return F.transform(F.sequence(F.lit(1), n), lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """(key, text_hash, license, containment, n_windows, first_word) of each template found in a document.

    A template is found where a window holds at least the share ``containment`` of its
    distinct shingles; ``containment`` is the best window's, ``first_word`` the first word of the first window
    that does. Null and empty texts, and texts of fewer than five words, give no row; an
    unlicensed text gives none. Rows with null keys take part; repeated
    rows of a document give one row, told by the xxhash64 of the text. Other columns are ignored. Templates of
    fewer than five words are an error.
    """
    templates = TEMPLATES if templates is None else templates
    short = [n for n, t in templates.items() if len(_words(t)) < SHINGLE]
    if short or len(templates) > MAX_TEMPLATES:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}" if short else "too many templates")
    spark = docs.sparkSession
    bands = bands_for(templates, containment)
    guards = guard_words(templates, containment)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.lower(text).alias("t"))
    guarded = F.lit(False)
    for g in guards:
        guarded |= F.col("t").contains(g)
    rows = rows.where(guarded).select("id", "text_hash", F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    rows = rows.where(F.size("w") >= SHINGLE)
    # windows of every class, cut before they become rows: a row holds its window, never the whole text
    marks = F.array(*map(F.lit, guards))
    windows = F.filter(F.flatten(F.array(*map(_windows, bands))), lambda p: F.arrays_overlap(p["w"], marks))
    rows = rows.select("id", "text_hash", F.explode(windows).alias("p")).select("id", "text_hash", "p.size", "p.at", "p.w")
    rows = rows.withColumn("has", F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("w") - SHINGLE + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, F.lit(SHINGLE)))))))
    rows = rows.select("id", "text_hash", "size", "at", "has", F.posexplode(
        _minhashes(F.col("has"), F.col("size"), bands)).alias("band", "value"))
    of = _template_bands(spark, templates, bands)
    pairs = rows.join(F.broadcast(of), ["size", "band", "value"])
    share = F.size(F.array_intersect("has", "of")) / F.size("of")
    pairs = pairs.withColumn("share", share).where(F.col("share") >= containment)
    pairs = pairs.groupBy("id", "text_hash", "license").agg(
        F.max("share").alias("containment"), F.count_distinct("at").alias("n_windows"), F.min("at").alias("first_word"))
    return pairs.select(F.col("id").alias(key), "text_hash", "license", "containment", "n_windows",
                        F.col("first_word").cast("long").alias("first_word"))


def _windows(size: int) -> Column:
    """(size, at, w): windows that start at each multiple of ``size``, until one reaches the end."""
    last = F.greatest(F.lit(0), F.floor((F.size("w") - SHINGLE) / F.lit(size)).cast("int") * size)
    return F.transform(F.sequence(F.lit(0), last, F.lit(size)), lambda i: F.struct(
        F.lit(size).alias("size"), i.alias("at"), F.slice("w", i + 1, F.lit(2 * size + SHINGLE - 1)).alias("w")))
