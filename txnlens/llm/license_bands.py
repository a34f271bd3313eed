"""Licence scan: MinHash bands of overlapping text windows retrieve licence templates, exact containment confirms them.

A text is lower-cased and split into words of letters and digits; shingles are five consecutive words (all words of a shorter
text). Templates are put into classes by their number of shingles. A class of at most c shingles uses windows of 2c shingles
that start every c, so any place of c shingles lies within one window. A template of such a class is more than two thirds of c,
so a window that contains four fifths of it has a Jaccard similarity of at least 0.25 to it, and 32 bands of one MinHash each
collide with a probability of at least 0.9999. Retrieved pairs count only if the window contains the stated share of the
template's shingles. Before that, texts and windows without any of a template's guard words are left out: more than a fifth of
its shingles hold such a word, so nothing that could match is lost.

Null and empty texts match nothing. Rows of a repeated doc_id count as one document, and so do rows without an id. Where windows
tie, the first counts. An empty table gives an empty result. Only DataFrame functions run.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, read_documents

WORDS = 5
SHARE = 0.8
BANDS = 32

#: Public licence notices, as (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
                 "by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_list(words: Column, k: int = WORDS) -> Column:
    """Runs of ``k`` words, repeats included; of a shorter list the whole, of an empty one nothing.

    Single elements are read, as a slice would copy the whole list for each run.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, runs).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def split_words(text: str) -> list[str]:
    """As ``word_list``, for the templates."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def shingles_of(text: str, k: int = WORDS) -> list[str]:
    words = split_words(text)
    return list(dict.fromkeys(" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1)))) if words else []


def class_size(n: int) -> int:
    """Least class that holds n shingles: 1, 2, 3, 4, 6, 8, 12, 16, 24 and so on."""
    size = 1
    while size < n:
        size = size + max(size // 2, 1) if size & (size - 1) == 0 else size // 3 * 4
    return size


def guards(text: str, share: float = SHARE) -> list[str]:
    """Words of which every sufficient part of the template's shingles has at least one."""
    shingles = [s.split() for s in shingles_of(text)]
    needed, open_, chosen = ceil(share * len(shingles) - 1e-9), shingles, []
    while len(open_) >= needed:
        counts: dict[str, int] = {}
        for s in open_:
            for w in set(s):
                counts[w] = counts.get(w, 0) + 1
        # Longer words are rarer in other texts; very short ones only as a last resort.
        word = max(counts, key=lambda w: (len(w) > 3, counts[w] * min(len(w), 8), w))
        chosen.append(word)
        open_ = [s for s in open_ if word not in s]
    return chosen


def template_bands(spark: SparkSession, templates, bands: int) -> DataFrame:
    """``(size, band, value, licence, template, shingles)``; its size depends on the templates alone."""
    rows = [(class_size(len(shingles_of(t))), licence, i, shingles_of(t)) for i, (licence, t) in enumerate(templates)]
    table = spark.createDataFrame(rows, "size int, licence string, template int, shingles array<string>")
    return table.select("size", "licence", "template", "shingles", F.posexplode(band_values(F.col("shingles"), bands)).alias("band", "value"))


def band_values(shingles: Column, bands: int) -> Column:
    """One MinHash a band."""
    def least(i: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(i))))

    return F.array(*[least(i) for i in range(bands)])


def windows(docs: DataFrame, templates) -> DataFrame:
    """``(doc_id, size, place, window)`` of all windows that hold a guard word of their class; ``place`` counts words from 0."""
    by_size: dict[int, set[str]] = {}
    for _, text in templates:
        by_size.setdefault(class_size(len(shingles_of(text))), set()).update(guards(text))
    every = sorted({w for s in by_size.values() for w in s})
    rows = clean_docs(docs).where(F.lower("text").rlike("|".join(every))).select("doc_id", word_list(F.col("text")).alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(every))
    rows = rows.where(F.size("words") > 0).select("doc_id", "words", shingle_list(F.col("words")).alias("shingles"), at.alias("at"))

    def of_class(size: int, own: set[str]) -> Column:
        last = F.greatest(F.ceil((F.size("shingles") - size) / F.lit(size)), F.lit(0)).cast("int")
        marked = F.filter("at", lambda i: F.get("words", i).isin(sorted(own)))
        # Window w holds the words from w * size up to w * size + 2 * size + 3.
        starts = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.filter(
            F.sequence(F.floor(i / size).cast("int") - (2 + (WORDS - 2) // size), F.floor(i / size).cast("int")),
            lambda w: (w >= 0) & (w <= last)))))
        return F.transform(starts, lambda w: F.struct(
            F.lit(size).alias("size"), (w * size).alias("place"),
            F.array_distinct(F.slice("shingles", w * size + 1, F.lit(2 * size))).alias("window")))

    found = [of_class(size, own) for size, own in sorted(by_size.items())]
    return rows.select("doc_id", F.explode(F.concat(*found)).alias("w")).select("doc_id", "w.*")


def license_matches(docs: DataFrame, templates=TEMPLATES, share: float = SHARE, bands: int = BANDS) -> DataFrame:
    """``(doc_id, license, containment, place)``: the best window of each licence a document names."""
    table = template_bands(docs.sparkSession, templates, bands)
    seen = windows(docs, templates).select("doc_id", "size", "place", "window", F.posexplode(band_values(F.col("window"), bands)).alias("band", "value"))
    # The table of the templates has a fixed size, so it may be sent to every task.
    held = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    pairs = seen.join(F.broadcast(table), ["size", "band", "value"]).select(
        "doc_id", "licence", "place", held.alias("held")).where(F.col("held") >= share)
    best = pairs.groupBy("doc_id", "licence").agg(F.max(F.struct("held", (-F.col("place")).alias("before"))).alias("best"))
    return best.select("doc_id", F.col("licence").alias("license"), F.col("best.held").alias("containment"),
                       (-F.col("best.before")).cast("long").alias("place"))


def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``, five-word shingles, four fifths of a template."""
    return license_matches(read_documents(spark, folder))


def oracle(templates=TEMPLATES, share: float = SHARE) -> str:
    """Exact containment of every template in every window of its class, without bands or guard words."""
    rows = ", ".join("({}, {}, '{}', [{}])".format(i, class_size(len(shingles_of(t))), licence, ", ".join(f"'{s}'" for s in shingles_of(t)))
                     for i, (licence, t) in enumerate(templates))
    return f"""
WITH templates(id, size, license, shingles) AS (VALUES {rows}),
words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
shingled AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1),
                                           lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) AS s FROM words WHERE len(w) > 0),
likely AS (SELECT * FROM shingled WHERE list_has_any(s, (SELECT flatten(list(shingles)) FROM templates))),
placed AS (SELECT doc_id, size, p * size AS place, list_distinct(s[p * size + 1:p * size + 2 * size]) AS win
           FROM likely, (SELECT DISTINCT size FROM templates) c, unnest(range(0, greatest(ceil((len(s) - size) / size), 0)::BIGINT + 1)) u(p)),
held AS (SELECT doc_id, license, place, len(list_intersect(win, shingles)) / len(shingles)::DOUBLE AS held
         FROM placed JOIN templates USING (size) WHERE list_has_any(win, shingles))
SELECT doc_id, license, max(held) AS containment, arg_max(place, (held, -place)) AS place
FROM held WHERE held >= {share} GROUP BY doc_id, license
"""
