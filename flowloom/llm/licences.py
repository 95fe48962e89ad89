"""Licence notices in documents, by the Dice coefficient over word bigrams.

Column functions do all the work. Every line of a document is brought to words of
lower-case letters and digits and to the set of its bigrams, and compared to templates:
twice the shared bigrams over the sum of both sizes. A template of b bigrams can reach a
threshold t only with lines of b*t/(2-t) to b*(2-t)/t bigrams, so the size of a line leaves
few templates. Before that, texts and lines are left out that hold none of the key words:
words so chosen that a line without any of them lacks more bigrams of each template than
the threshold allows.

`scan_licences` compares whole lines. `scan_notices` finds notices that are wrapped over
lines or lie inside a paragraph: it compares windows of the words of the whole text, each as
long as a template and placed so that a key word of both stands at the same place.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
# Words that tell no licence from other texts.
COMMON = frozenset("a and any by for in is of on or that the this to under with you".split())

# Notices by which licences are declared.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template in their order."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Bigram counts between which a line can reach the threshold with a template."""
    slack = 1e-9
    return (
        math.ceil(size * threshold / (2 - threshold) - slack),
        math.floor(size * (2 - threshold) / threshold + slack),
    )


def key_words(known: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every line that reaches the threshold with any template has one.

    A line shares at least b*t/(2-t) of the b bigrams of a template. Words are added, the
    one that leaves the fewest bigrams over all templates first, until each template has
    fewer than that without them.
    """
    needed = {name: size_bounds(len(pairs), threshold)[0] for name, pairs in known.items()}
    left = {name: list(pairs) for name, pairs in known.items()}
    chosen: list[str] = []
    while open_ones := [name for name in left if len(left[name]) >= needed[name]]:
        gains: dict[str, int] = {}
        for name in open_ones:
            for pair in left[name]:
                for word in set(pair.split()):
                    gains[word] = gains.get(word, 0) + 1
        # Short and common words are everywhere; a long one tells licences from other texts.
        word = max(gains, key=lambda w: (w not in COMMON, gains[w] * len(w) ** 3, w))
        chosen.append(word)
        for name in left:
            left[name] = [pair for pair in left[name] if word not in pair.split()]
    return sorted(chosen)


def bigrams_of(words: Column) -> Column:
    """The distinct bigrams of an array of words."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), n - 1),
        F.slice(words, F.lit(2), n - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan_licences(
    docs: DataFrame,
    *,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, line_no, licence, dice, n_bigrams): the licence that each line declares.

    Lines end at line feeds and count from 1. Of templates at or above the threshold, the
    one of the largest coefficient is reported, of equals the first by name; other lines
    have no row. Null and empty texts and lines of less than two words have none either;
    a null `doc_id` is kept, and a row that occurs again gives its lines again. Nothing is
    shuffled.
    """
    known = {name: template_bigrams(body) for name, body in (TEMPLATES if templates is None else templates).items()}
    known = {name: pairs for name, pairs in known.items() if pairs}
    keys = key_words(known, threshold)
    if not known:
        return docs.limit(0).select(
            F.col(doc_id).alias("doc_id"),
            F.lit(1).cast("bigint").alias("line_no"),
            F.lit("").alias("licence"),
            F.lit(0.0).alias("dice"),
            F.lit(0).cast("bigint").alias("n_bigrams"),
        )
    smallest = min(size_bounds(len(pairs), threshold)[0] for pairs in known.values())
    largest = max(size_bounds(len(pairs), threshold)[1] for pairs in known.values())
    offered = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(size_bounds(len(pairs), threshold)[0]).alias("least"),
                F.lit(size_bounds(len(pairs), threshold)[1]).alias("most"),
                F.array(*map(F.lit, pairs)).alias("pairs"),
            )
            for name, pairs in sorted(known.items())
        )
    )
    def promising(column: str) -> Column:
        # A lambda variable holds the lower-case text once for all key words.
        lower = F.array(F.lower(column))
        return F.exists(lower, lambda x: reduce(or_, (F.contains(x, F.lit(k)) for k in keys)))

    # Texts first, so that most are never split, then lines.
    lines = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .filter(promising("text"))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .filter(promising("line"))
    )
    words = lines.select(
        "doc_id",
        (F.col("at") + 1).cast("bigint").alias("line_no"),
        F.split(F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " ")), " ").alias("words"),
    )
    sized = words.select("doc_id", "line_no", bigrams_of(F.col("words")).alias("own")).filter(
        F.size("own").between(smallest, largest)
    )
    n = F.size("own")
    compared = F.transform(
        F.filter(offered, lambda x: n.between(x["least"], x["most"])),
        lambda x: F.struct(
            (
                F.lit(2.0)
                * F.size(F.array_intersect(F.col("own"), x["pairs"]))
                / (n + F.size(x["pairs"]))
            ).alias("dice"),
            x["name"].alias("name"),
        ),
    )
    best = F.aggregate(
        compared,
        F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name")),
        lambda found, x: F.when(x["dice"] > found["dice"], x).otherwise(found),
    )
    return (
        sized.select("doc_id", "line_no", best.alias("best"), n.cast("bigint").alias("n_bigrams"))
        .filter(F.col("best.dice") >= threshold)
        .select(
            "doc_id",
            "line_no",
            F.col("best.name").alias("licence"),
            F.col("best.dice").alias("dice"),
            "n_bigrams",
        )
    )


def scan_notices(
    docs: DataFrame,
    *,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(licence, doc_id, first_word, n_words, dice): notices anywhere in texts, line ends or not.

    A window has as many words as its template, less at the ends of a text. Of windows at
    or above the threshold that overlap, the one that shares the most bigrams is reported,
    of equals the one of the larger coefficient, then the first by name and by place. Words
    count from 1. Null and empty texts have no rows; a null `doc_id` is kept, and a row that
    occurs again gives its notices again. Nothing is shuffled.
    """
    bodies = sorted((TEMPLATES if templates is None else templates).items())
    known = {name: template_bigrams(body) for name, body in bodies}
    known = {name: pairs for name, pairs in known.items() if pairs}
    if not known:
        return docs.limit(0).select(
            F.lit("").alias("licence"),
            F.col(doc_id).alias("doc_id"),
            F.lit(1).cast("bigint").alias("first_word"),
            F.lit(1).cast("bigint").alias("n_words"),
            F.lit(0.0).alias("dice"),
        )
    keys = key_words(known, threshold)
    worded = {n: re.sub(r"[^a-z0-9]+", " ", b.lower()).split() for n, b in bodies if n in known}
    names = F.array(*map(F.lit, known))
    sizes = F.array(*(F.lit(len(worded[name])) for name in known))
    bigrams = F.array(*(F.array(*map(F.lit, pairs)) for pairs in known.values()))
    # A window is one number: the template, and the place of its first word, which may lie
    # before the text.
    ahead, step = 1 << 20, 1 << 40
    anchors = F.array(
        *(
            F.struct(F.lit(word).alias("key"), F.lit(t * step + ahead - at).alias("move"))
            for t, name in enumerate(known)
            for at, word in enumerate(worded[name])
            if word in keys
        )
    )
    lower = F.array(F.lower("text"))
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .filter(F.exists(lower, lambda x: reduce(or_, (F.contains(x, F.lit(k)) for k in keys))))
        .select(
            "doc_id",
            F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ").alias("words"),
        )
    )
    numbered = F.transform(
        "words", lambda word, i: F.struct(i.cast("bigint").alias("at"), word.alias("word"))
    )
    placed = F.transform(
        F.filter(numbered, lambda x: x["word"].isin(keys)),
        lambda x: F.transform(
            F.filter(anchors, lambda a: a["key"] == x["word"]), lambda a: a["move"] + x["at"]
        ),
    )
    windows = F.transform(
        F.array_distinct(F.flatten(placed)),
        lambda code: F.struct(
            (F.shiftright(code, 40) + 1).cast("int").alias("template"),
            (code.bitwiseAND(F.lit(step - 1)) - ahead).cast("int").alias("start"),
        ),
    )

    def compared(x: Column) -> Column:
        first = F.greatest(x["start"], F.lit(0))
        end = F.least(x["start"] + F.element_at(sizes, x["template"]), F.size("words"))
        pairs = F.element_at(bigrams, x["template"])
        # Lambda variables hold the words and bigrams of the window once.
        own = F.transform(F.array(F.slice("words", first + 1, end - first)), bigrams_of)
        found = F.transform(
            own,
            lambda own: F.struct(
                F.size(F.array_intersect(own, pairs)).alias("shared"),
                (F.size(own) + F.size(pairs)).alias("both"),
            ),
        )
        return F.element_at(
            F.transform(
                found,
                lambda f: F.struct(
                    (-f["shared"]).alias("order"),
                    (F.lit(-2.0) * f["shared"] / f["both"]).alias("dice"),
                    F.element_at(names, x["template"]).alias("name"),
                    first.alias("first"),
                    end.alias("end"),
                ),
            ),
            1,
        )

    reached = rows.select(
        "doc_id",
        F.array_sort(
            F.filter(F.transform(windows, compared), lambda x: -x["dice"] >= threshold)
        ).alias("reached"),
    ).filter(F.size("reached") > 0)
    # The best first, then each that overlaps none of those before.
    kept = F.aggregate(
        "reached",
        F.filter("reached", lambda x: F.lit(False)),
        lambda kept, x: F.when(
            F.exists(kept, lambda y: (x["first"] < y["end"]) & (y["first"] < x["end"])), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )
    return reached.select("doc_id", F.explode(kept).alias("x")).select(
        F.col("x.name").alias("licence"),
        "doc_id",
        (F.col("x.first") + 1).cast("bigint").alias("first_word"),
        (F.col("x.end") - F.col("x.first")).cast("bigint").alias("n_words"),
        (-F.col("x.dice")).alias("dice"),
    )


def licence_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result in SQL over the table `documents`, comparing every line and template."""
    rows = ", ".join(
        "('{}', [{}])".format(name, ", ".join(f"'{pair}'" for pair in template_bigrams(body)))
        for name, body in sorted((TEMPLATES if templates is None else templates).items())
    )
    return f"""
WITH templates(licence, pairs) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, CAST(generate_subscripts(split, 1) AS BIGINT) AS line_no, unnest(split) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS split FROM documents)
),
worded AS (
  SELECT doc_id, line_no,
    string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ') AS words
  FROM lines
),
bigrams AS (
  SELECT doc_id, line_no,
    list_distinct([words[j] || ' ' || words[j + 1] FOR j IN range(1, len(words))]) AS own
  FROM worded WHERE len(words) > 1
),
compared AS (
  SELECT doc_id, line_no, licence, CAST(len(own) AS BIGINT) AS n_bigrams,
    CAST(2.0 AS DOUBLE) * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice
  FROM bigrams CROSS JOIN templates
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, licence) AS r
  FROM compared WHERE dice >= {threshold}
)
SELECT doc_id, line_no, licence, dice, n_bigrams FROM ranked WHERE r = 1
"""
