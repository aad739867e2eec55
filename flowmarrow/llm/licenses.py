"""Licence scan by the Dice coefficient over word bigrams.

The units of a text are the whole text, its paragraphs, its lines and its sentences. Units and templates are normalised: lower case,
runs of letters or digits as words, notices of a copyright holder left out. A unit matches a template if twice the
number of common distinct bigrams is at least the threshold share of both numbers together, and of the templates that a
unit matches the most alike stands, or all that are equally so. This bounds the size of a
unit by that of the template, so units of other sizes never meet it; the rest meet by their bigrams, and only pairs
with a common bigram are counted. A text without any of the words that a match cannot do without is not taken apart. The templates are a bounded parameter; texts are never shuffled.

Null and empty texts match nothing. Equal texts have equal results, whatever their ids; every row is returned.
"""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.llm.text import let, query, table, whole
from flowmarrow.session import frozen

#: Least Dice coefficient, percent.
PERCENT = 80
#: Templates must be few: their bigrams are sent to all executors.
MOST_TEMPLATES = 5000
# Licence ids and the wording of their notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]


#: A line that names a copyright holder; blanks before it do not run on over empty lines.
COPYRIGHT = r"(?m)^[\x20\t\x0B\f\r]*copyright\s.*$"
SENTENCE_END = r"[.!?][\x20\t\r\n]+"


def bigrams(text: Column) -> Column:
    """Hashes of the distinct word pairs of a text."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    words = F.transform(F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))
    pairs = let(words, lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))), 1, F.greatest(F.size(w) - 1, F.lit(0))))
    return F.array_distinct(pairs)


def units(text: Column) -> Column:
    """The distinct units of a text that have a word."""
    t = whole(text)
    parts = F.concat(F.array(t), F.split(t, r"\n[\x20\t\r]*\n"), F.split(t, "\n"), F.split(t, SENTENCE_END))
    return F.filter(F.array_distinct(parts), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def needed_words(templates: list[tuple[str, str]], percent: int) -> list[str]:
    """Words one of which every text with a match contains.

    A match has all but a few of its template's bigrams, so of one bigram more than these few at least one is there, and with it
    each of its words. Words that serve several templates come first, then long ones, which are rare.
    """
    grams = []
    for _, body in templates:
        words = regex.findall(r"[\p{L}\p{N}]+", regex.sub(COPYRIGHT, " ", body.lower()))
        grams.append(sorted(set(zip(words, words[1:]))))
    uses = Counter(w for g in grams for w in {w for pair in g for w in pair})
    chosen: set[str] = set()
    for g in grams:
        m = len(g)
        least = -(-m * percent // (200 - percent))
        common = max(1, -(-percent * (least + m) // 200))
        best = lambda pair: max(pair, key=lambda w: (w in chosen, len(w) * min(uses[w], 4), w))
        by_word = sorted((best(pair) for pair in g), key=lambda w: (w not in chosen, -len(w) * min(uses[w], 4), w))
        chosen.update(by_word[: m - common + 1])
    return sorted(chosen)


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(key, unit, license, common, size): units of distinct texts that match a template; ``key`` is the text's digest."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError("too many templates to send to all executors")
    known = docs.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, body string")
    known = known.select("template", "license", bigrams(F.col("body")).alias("grams"))
    known = known.select("template", "license", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    words = "|".join(needed_words(templates, percent))
    hopeful = docs.where(F.lower(whole(F.col("text"))).rlike(words)) if words else docs.where(F.lit(False))
    u = hopeful.select(F.md5(whole(F.col("text"))).alias("key"), F.posexplode(units(F.col("text"))).alias("unit", "part"))
    longest = max((len(body) for _, body in templates), default=0)
    # a unit has no more bigrams than twice the bound allows for the longest template, and a word has a letter
    u = u.select("key", "unit", bigrams(F.col("part")).alias("grams"))
    u = u.select("key", "unit", F.size("grams").alias("n"), "grams").where(F.col("n") * percent <= longest * (200 - percent))
    u = u.select("key", "unit", "n", F.explode("grams").alias("gram"))
    fits = (
        (u.gram == known.gram) & (F.col("n") * (200 - percent) >= F.col("m") * percent)
        & (F.col("m") * (200 - percent) >= F.col("n") * percent)
    )
    met = u.join(F.broadcast(known), fits).select("key", "unit", "template", "license", "n", "m", u.gram).distinct()
    met = met.groupBy("key", "unit", "template", "license", "n", "m").agg(F.count(F.lit(1)).alias("common"))
    good = met.where(F.col("common") * 200 >= percent * (F.col("n") + F.col("m")))
    dice = F.col("common") / (F.col("n") + F.col("m"))
    good = good.withColumn("most", F.max(dice).over(Window.partitionBy("key", "unit"))).where(dice == F.col("most"))
    return good.select("key", "unit", "license", "common", (F.col("n") + F.col("m")).alias("size"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, licenses, best): the licences of every document, sorted, and the best coefficient."""
    found = matches(docs, templates, percent).groupBy("key").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.max(F.round(F.lit(2) * F.col("common") / F.col("size"), 6)).alias("best"),
    )
    found = frozen(found, "licences")
    d = docs.select("doc_id", F.md5(whole(F.col("text"))).alias("key")).join(found, "key", "left")
    return d.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))


def _sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
    grams = r"""list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"""
    words = r"""list_filter(regexp_split_to_array(regexp_replace(lower({0}), '(?m)^[\x20\t\x0B\f\r]*copyright\s.*$', ' ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
    return f"""
WITH t AS (SELECT tid, license, {grams} AS g FROM (SELECT tid, license, {words.format("body")} AS words FROM (VALUES {rows}) v(tid, license, body))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT rid, unnest(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), string_split(text, chr(10)),
  regexp_split_to_array(text, '[.!?][ \\t\\r\\n]+'))) AS part FROM d),
g AS (SELECT row_number() OVER () AS nr, rid, {grams} AS g FROM (SELECT rid, {words.format("part")} AS words FROM u)),
a AS (SELECT nr, rid, license, len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS share, round(2 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)), 6) AS dice FROM g JOIN t
  ON 120 * len(g.g) >= 80 * len(t.g) AND 120 * len(t.g) >= 80 * len(g.g) AND len(g.g) > 0
  WHERE 200 * len(list_intersect(g.g, t.g)) >= 80 * (len(g.g) + len(t.g))),
m AS (SELECT * FROM (SELECT *, max(share) OVER (PARTITION BY nr) AS most FROM a) WHERE share = most)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(best, 0.0) AS best FROM d LEFT JOIN
  (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best FROM m GROUP BY rid) USING (rid)"""


@query(_sql())
def op9_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
