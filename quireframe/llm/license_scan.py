"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of the texts are joined, by hash and then word by word, to the positions of the same
k-grams in license templates. A copied passage shows as many hits with one difference of positions: hits vote for
their diagonal, diagonals of one text and template that lie near each other are merged (words put in or left out
move a passage from one to the next), and a merged span counts if it covers enough of the template: half of the words
of a passage, all but one of a short notice. The templates are a fixed table of some hundred words, which is why it is
broadcast; a larger one given instead is joined by its hashes.

Defined results: a null text is an empty one: no words, no places, null positions, empty labels, score 0. Repeated
rows are scanned one by one. Ties between spans do not matter: the score is the largest cover. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

# Phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
# Opening passages of public license notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
# Short public notices and identifiers, in which files name their license.
NOTICES = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
#: Words of a k-gram, distance of lanes that are one, cover that counts; of templates shorter than SHORT words, all but one word.
K, NEAR, COVER, SHORT = 4, 3, 0.5, 20
#: Templates with up to so many words are broadcast.
BROADCAST_WORDS = 200_000
ALL = {label: (*((TEMPLATES[label],) if label in TEMPLATES else ()), *NOTICES.get(label, ())) for label in {**TEMPLATES, **NOTICES}}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def grams(w: Column, k: int = K) -> Column:
    """Hashes of the k words from each place on."""
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(
        F.array().cast("array<long>")
    )


def template_table(spark: SparkSession, templates: dict[str, str | Sequence[str]], k: int, cover: float = COVER) -> DataFrame:
    """A row a k-gram place: which template, its label, its words and the least of them that count, the place, hash and words there."""
    texts = [(label, t) for label, some in sorted(templates.items()) for t in ((some,) if isinstance(some, str) else some)]
    rows = spark.createDataFrame([(i, label, t) for i, (label, t) in enumerate(texts)], "tid int, label string, text string").withColumn("w", words(F.col("text")))
    n = F.size("w")
    rows = rows.select("tid", "label", n.alias("len"), F.when(n < SHORT, n - 1).otherwise(F.ceil(n * cover)).cast("int").alias("need"), "w", F.posexplode(grams(F.col("w"), k)).alias("t", "h"))
    out = rows.select("tid", "label", "len", "need", "t", "h", F.slice("w", F.col("t") + 1, k).alias("tw"))
    return F.broadcast(out) if sum(len(t) for _, t in texts) <= 8 * BROADCAST_WORDS else out


def phrase_places(w: Column) -> Column:
    """Where the words of any phrase stand one after another, ascending, for each phrase."""

    def at(phrase: tuple[str, ...]) -> Column:
        n = F.size(w) - len(phrase)
        hit = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + j) == x for j, x in enumerate(phrase)])
        return F.when((n >= 0) & F.array_contains(w, phrase[0]) & F.array_contains(w, phrase[-1]), F.filter(F.sequence(F.lit(0), n), hit)).otherwise(
            F.array().cast("array<int>")
        )

    return F.struct(*[F.coalesce(at(p), F.array().cast("array<int>")).alias(label) for p, label in PHRASES.items()])


def spans(scanned: DataFrame, templates: DataFrame, k: int = K, near: int = NEAR) -> DataFrame:
    """Verified spans: row, label, first and last word in the text, share of the template that is covered.

    scanned has row and w, the words.
    """
    name = ["row", "tid", "label", "len", "need"]
    hits = (
        scanned.select("row", "w", F.posexplode(grams(F.col("w"), k)).alias("d", "g"))
        .join(templates, F.col("g") == F.col("h"))
        .where(F.slice("w", F.col("d") + 1, k) == F.col("tw"))
        .select(*name, "d", "t")
    )
    # a lane holds a passage once for each place where it stands, all of one difference: a hit a template place at most
    lanes = hits.groupBy(*name, (F.col("d") - F.col("t")).alias("lane")).agg(F.collect_set("t").alias("ts"), F.min("d").alias("first"), (F.max("d") + k - 1).alias("last"))
    w = Window.partitionBy("row", "tid").orderBy("lane")
    lanes = lanes.withColumn("new", (F.col("lane") - F.lag("lane", 1).over(w) > near).cast("int"))
    lanes = lanes.withColumn("grp", F.sum(F.coalesce("new", F.lit(0))).over(w))
    merged = lanes.groupBy(*name, "grp").agg(
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("first").alias("first"), F.max("last").alias("last")
    )  # a template is a few dozen words long, and so is what is gathered of it
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (k - 1))))))
    found = merged.withColumn("covered", covered).where(F.col("covered") >= F.greatest(F.col("need"), F.lit(k)))
    return found.select("row", "label", "first", "last", (F.col("covered") / F.col("len")).alias("cover"))


def scan(docs: DataFrame, templates: dict[str, str | Sequence[str]] = ALL, k: int = K, near: int = NEAR, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, places of phrases, labels of phrases and of verified spans, best cover."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    base = base.withColumn("w", words(F.col("text")))
    found = spans(base.select("row", "w"), template_table(spark, templates, k, cover), k, near)
    best = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("best"))
    places = base.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w")).alias("p"))
    every = F.concat(*[F.col(f"p.{label}") for label in PHRASES.values()])
    named = F.array_compact(F.array(*[F.when(F.size(f"p.{label}") > 0, F.lit(label)) for label in PHRASES.values()]))
    own = places.select(
        "doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(named).alias("named"),
    )
    return own.join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("named", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
