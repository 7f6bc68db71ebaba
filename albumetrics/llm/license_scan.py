"""Licence notices in documents: normalised text against templates, by the Dice coefficient over word bigrams.

A candidate is a run of one to ``MAX_LINES`` consecutive lines of a document. Its text is normalised (lower case, every
run of other than letters and digits becomes one space) and its distinct word bigrams are compared with those of each
template: ``2 * shared / (n + m)``. A coefficient of at least ``t`` needs ``n`` between ``m * t / (2 - t)`` and
``m * (2 - t) / t``, so a template is compared only with runs inside its bounds, and runs with too few words for every
template never become rows. It also needs all but ``m - m * t / (2 - t)`` of the template's bigrams. So each template
has a few key words that lie in more bigrams than may be missing: a run without any of them cannot match, and documents
that hold no template's key word are passed over by plain substring tests.

Notices inside longer lines, and those wrapped over more lines, are found by windows of words over the whole text. A window
that begins or ends with a bigram the template lacks is no better than without it, so windows run from one place of a
template's bigrams to another, over at least as many of them as a match shares and at most as many words as the bounds
allow (besides those that the template repeats). Windows count only where no run of lines matches the licence; the lines
of a result are then those that the window touches. The text is cut into stretches of ``STRETCH`` bigrams and what a window
begun there may reach, so work is linear in the text.

All steps are column functions over single rows; there is no shuffle before the last grouping, and the result has a row for each document and
template that match: the best coefficient, the first line of the best run (the earliest, then the shortest, on a tie),
its number of lines, and how many runs matched.

Defined cases: null or empty texts, and empty tables, give no rows; rows of one id count as one document; lines without
words count as lines of no words, and a run starts and ends with a line that has one.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.common import prepare

LEAST_DICE = 0.8
MAX_LINES = 4

# The notices that the licences (or their stewards) prescribe for source files, by SPDX id.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}

# Words of the templates that most English texts hold; they only steer which key words are chosen.
FREQUENT = set("a and are at be by for in is it may not of on or that the this to under use was with you".split())

#: Bigrams of one stretch of a text, besides those that a window begun in it may still reach.
STRETCH = 512
WORD_BREAK = r"[^\p{L}\p{N}]+"


def normalise(text: str) -> list[str]:
    """The words of a template; documents get the same by column functions."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(m: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams that can reach the coefficient against ``m`` bigrams."""
    return math.ceil(m * least / (2 - least) - 1e-9), math.floor(m * (2 - least) / least + 1e-9)


def key_words(words: list[str], least: float) -> list[str]:
    """Words that lie in more of the bigrams than a match may lack; those that are rare elsewhere come first."""
    grams = set(zip(words, words[1:]))
    lack = len(grams) - size_bounds(len(grams), least)[0]
    chosen: list[str] = []
    covered: set = set()
    for word in sorted(set(words), key=lambda w: (w in FREQUENT, -len(w), w)):
        if len(covered) > lack:
            break
        chosen.append(word)
        covered |= {g for g in grams if word in g}
    return chosen


def longest_window(words: list[str], least: float) -> int:
    """Bigrams, repeated ones too, in the longest window."""
    m = len(bigrams(words))
    return size_bounds(m, least)[1] + len(words) - 1 - m


def window_hits(table: Column, least: float) -> Column:
    """Matching windows of one stretch as (line, n_lines, license, dice), from its ``grams``, ``line_of``, ``own`` and ``spots``.

    A window counts in the stretch in whose first ``own`` bigrams it begins.
    """
    def windows(t: Column) -> Column:
        first, at = F.element_at, t["at"]

        def from_place(k: Column) -> Column:
            ends = F.filter(F.sequence(k + t["low"] - 1, F.size(at)), lambda e: first(at, e) - first(at, k) < t["span"])
            own = F.transform(ends, lambda e: F.struct(
                first(at, k).alias("start"), first(at, e).alias("end"),
                F.array_distinct(F.slice("grams", first(at, k), first(at, e) - first(at, k) + 1)).alias("own")))
            return F.transform(own, lambda w: F.struct(
                first("line_of", w["start"]).alias("line"),
                (first("line_of", w["end"] + 1) - first("line_of", w["start"]) + 1).alias("n_lines"),
                t["license"].alias("license"),
                (F.lit(2.0) * F.size(F.array_intersect(w["own"], t["grams"])) / (F.size(w["own"]) + F.size(t["grams"])))
                .alias("dice")))

        starts = F.filter(F.sequence(F.lit(1), F.size(at) - t["low"] + 1),
                          lambda k: (first(at, k) <= F.col("own")) & (first(at, k + t["low"] - 1) - first(at, k) < t["span"]))
        return F.filter(F.flatten(F.transform(starts, from_place)), lambda w: w["dice"] >= least)

    placed = F.transform(table, lambda t: F.struct(
        t["license"].alias("license"), t["low"].alias("low"), t["span"].alias("span"), t["grams"].alias("grams"),
        F.transform(F.filter("spots", lambda x: F.array_contains(t["grams"], x["gram"])), lambda x: x["at"]).alias("at")))
    return F.flatten(F.transform(F.filter(placed, lambda t: F.size(t["at"]) >= t["low"]), windows))


def _pairs(words: Column, first: Column, last: Column) -> Column:
    """Bigrams from word ``first`` to word ``last``; single elements are read, so no array is copied for each of them."""
    return F.when(last > first, F.transform(
        F.sequence(first, last - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))
    )).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_DICE,
         max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``license``, ``dice``, ``line`` (from 1), ``n_lines``, ``n_runs``."""
    prepare(docs.sparkSession)
    flat = [(name, bigrams(normalise(text))) for name, texts in (templates or TEMPLATES).items() for text in texts]
    bounds = [size_bounds(len(grams), least) for _, grams in flat]
    fewest = min(a for a, _ in bounds)
    keys = sorted({w for texts in (templates or TEMPLATES).values() for t in texts for w in key_words(normalise(t), least)})
    spans = [longest_window(normalise(t), least) for texts in (templates or TEMPLATES).values() for t in texts]
    table = F.array(*(
        F.struct(F.lit(name).alias("license"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(span).alias("span"),
                 F.array(*map(F.lit, grams)).alias("grams"))
        for (name, grams), (low, high), span in zip(flat, bounds, spans)
    ))
    low = F.lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), low.alias("low"))
    rows = rows.filter(reduce(lambda a, b: a | b, (F.contains(F.col("low"), F.lit(k)) for k in keys)))
    lines = F.transform(F.split("low", "\n"), lambda line: F.filter(F.split(line, WORD_BREAK), lambda w: w != ""))
    rows = rows.select("id", lines.alias("lines"))
    held = F.array(*map(F.lit, keys))
    rows = rows.select(
        "id", "lines", F.flatten("lines").alias("words"),
        F.flatten(F.transform("lines", lambda words, k: F.array_repeat(k + 1, F.size(words)))).alias("line_of"),
        F.transform("lines", F.size).alias("sizes"), F.transform("lines", lambda words: F.arrays_overlap(words, held)).alias("keyed"))

    # A piece is a run of lines with its words, or a stretch of the text with the lines of its words. Every piece takes its
    # words along when it becomes a row, and all are cut out element by element, so the work is linear in the text.
    none, words = F.lit(None), "array<string>"

    def runs_of(n: int) -> Column:
        at = lambda name, s, i: F.element_at(name, s + i)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size("sizes") - (n - 1), F.lit(1))),
            lambda s: (s + (n - 1) <= F.size("sizes"))
            & reduce(lambda a, b: a | b, (F.get("keyed", s + (i - 1)) for i in range(n)))
            & (F.get("sizes", s - 1) > 0) & (F.get("sizes", s + (n - 2)) > 0)
            & (reduce(lambda a, b: a + b, (F.get("sizes", s + (i - 1)) for i in range(n))) > fewest))
        return F.transform(starts, lambda s: F.struct(
            s.alias("line"), F.lit(n).alias("n_lines"),
            F.flatten(F.array(*(at("lines", s, i) for i in range(n)))).alias("words"),
            none.cast("array<int>").alias("line_of"), none.cast("int").alias("own")))

    reach = max(spans)
    cut = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(STRETCH))

    def stretch(first: Column) -> Column:
        last = F.least(first + (STRETCH + reach), F.size("words"))
        places = F.sequence(first, F.greatest(last, first))
        return F.struct(
            none.cast("int").alias("line"), none.cast("int").alias("n_lines"),
            F.transform(places, lambda i: F.get("words", i - 1)).alias("words"),
            F.transform(places, lambda i: F.get("line_of", i - 1)).alias("line_of"), F.lit(STRETCH).alias("own"))

    pieces = rows.select("id", F.explode(F.concat(
        *(runs_of(n) for n in range(1, max_lines + 1)), F.transform(cut, stretch))).alias("piece")).select("id", "piece.*")
    pieces = pieces.withColumn("grams", _pairs(F.col("words"), F.lit(1), F.size("words"))).drop("words")
    wanted = sorted({g for _, grams in flat for g in grams})
    spots = F.filter(F.transform("grams", lambda g, k: F.struct((k + 1).alias("at"), g.alias("gram"))), lambda x: x["gram"].isin(wanted))
    whole = F.col("own").isNull()
    pieces = pieces.withColumn("spots", F.when(~whole, spots))
    pieces = pieces.withColumn("grams", F.when(whole, F.array_distinct("grams")).otherwise(F.col("grams")))
    fitting = F.filter(table, lambda t: F.size("grams").between(t["low"], t["high"]))
    scored = F.transform(fitting, lambda t: F.struct(
        F.col("line"), F.col("n_lines"), t["license"].alias("license"),
        (F.lit(2.0) * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (F.size("grams") + F.size(t["grams"])))
        .alias("dice"),
    ))
    found = F.when(whole, F.filter(scored, lambda s: s["dice"] >= least)).otherwise(window_hits(table, least))
    hits = pieces.select("id", whole.alias("whole"), F.explode(found).alias("hit")).select("id", "whole", "hit.*")
    best = F.max_by(F.struct("line", "n_lines"), F.struct(F.col("dice"), -F.col("line"), -F.col("n_lines")))
    out = hits.groupBy("id", "license", "whole").agg(
        F.max("dice").alias("dice"), best.alias("best"), F.countDistinct("line", "n_lines").alias("n_runs"))
    out = out.groupBy("id", "license").agg(F.max_by(F.struct("dice", "best", "n_runs"), "whole").alias("x"))
    out = out.select("id", "license", "x.dice", "x.best", "x.n_runs")
    return out.select(
        F.col("id").alias(id_col), "license", "dice", F.col("best.line").cast("long").alias("line"),
        F.col("best.n_lines").cast("long").alias("n_lines"), "n_runs")


def oracle(templates: dict[str, list[str]] | None = None, least: float = LEAST_DICE, max_lines: int = MAX_LINES) -> str:
    """The same result over ``documents`` in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(
        f"({k}, {quote(name)}, {quote(text)})"
        for k, (name, text) in enumerate((n, t) for n, texts in (templates or TEMPLATES).items() for t in texts)
    )
    every = [text for texts in (templates or TEMPLATES).values() for text in texts]
    reaches = [
        f"({k}, {size_bounds(len(bigrams(normalise(text))), least)[0]}, {longest_window(normalise(text), least)})"
        for k, text in enumerate(every)]
    tokens = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH templates(t, license, text) AS (VALUES {values}),
known AS (SELECT t, license, {pairs.format("words")} AS grams
          FROM (SELECT t, license, {tokens.format("text")} AS words FROM templates)),
split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > 0),
numbered AS (SELECT doc_id, line, {tokens.format("lines[line]")} AS words
             FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM split)),
runs AS (
  SELECT a.doc_id, a.line, n.n AS n_lines, flatten(list(b.words ORDER BY b.line)) AS words
  FROM numbered a CROSS JOIN (SELECT unnest(range(1, {max_lines + 1})) AS n) n
  JOIN numbered b ON b.doc_id = a.doc_id AND b.line BETWEEN a.line AND a.line + n.n - 1
  GROUP BY a.doc_id, a.line, n.n
  HAVING count(*) = n.n AND len(arg_min(b.words, b.line)) > 0 AND len(arg_max(b.words, b.line)) > 0),
grammed AS (SELECT doc_id, line, n_lines, {pairs.format("words")} AS grams FROM runs WHERE len(words) > 1),
hits AS (
  SELECT g.doc_id, k.license, g.line, g.n_lines,
         2.0::DOUBLE * len(list_intersect(g.grams, k.grams)) / (len(g.grams) + len(k.grams)) AS dice
  FROM grammed g JOIN known k ON len(g.grams) BETWEEN 1 AND 3 * len(k.grams)),
flat AS (SELECT doc_id, flatten(list(words ORDER BY line)) AS words,
                flatten(list(list_transform(words, lambda w: line) ORDER BY line)) AS line_of FROM numbered GROUP BY doc_id),
texts AS (SELECT doc_id, line_of, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS grams
          FROM flat WHERE len(words) > 1),
reach(t, low, span) AS (VALUES {", ".join(reaches)}),
spots AS (SELECT p.doc_id, k.t, p.at, row_number() OVER (PARTITION BY p.doc_id, k.t ORDER BY p.at) AS n
          FROM (SELECT doc_id, unnest(range(1, len(grams) + 1)) AS at, unnest(grams) AS gram FROM texts) p
          JOIN (SELECT t, unnest(grams) AS gram FROM known) k USING (gram)),
windows AS (SELECT a.doc_id, a.t, a.at AS start, b.at AS stop
            FROM spots a JOIN reach r USING (t) JOIN spots f ON f.doc_id = a.doc_id AND f.t = a.t AND f.n = a.n + r.low - 1 AND f.at - a.at < r.span
            JOIN spots b ON b.doc_id = a.doc_id AND b.t = a.t AND b.n >= f.n AND b.at - a.at < r.span),
inside AS (SELECT w.doc_id, k.license, x.line_of[w.start] AS line, x.line_of[w.stop + 1] - x.line_of[w.start] + 1 AS n_lines,
           2.0::DOUBLE * len(list_intersect(list_distinct(x.grams[w.start:w.stop]), k.grams))
             / (len(list_distinct(x.grams[w.start:w.stop])) + len(k.grams)) AS dice
           FROM windows w JOIN texts x USING (doc_id) JOIN known k USING (t))
SELECT doc_id, license, max(dice) AS dice,
       arg_max(line, (dice, -line, -n_lines))::BIGINT AS line,
       arg_max(n_lines, (dice, -line, -n_lines))::BIGINT AS n_lines,
       count(DISTINCT (line, n_lines)) AS n_runs
FROM (SELECT *, max(whole) OVER (PARTITION BY doc_id, license) AS any_whole
      FROM (SELECT *, 1 AS whole FROM hits UNION ALL SELECT *, 0 FROM inside) WHERE dice >= {least})
WHERE whole = any_whole GROUP BY doc_id, license
"""
