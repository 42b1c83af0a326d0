"""License scans: parts of a text against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: A-Z in lower case, and every run of other characters than a-z and 0-9 becomes
one blank. The parts are the lines, the paragraphs of several lines, and a whole text of several lines. Bigrams count
with their multiplicity, so a part of n words has n - 1, and a Dice coefficient of at least t bounds its size to
t / (2 - t) up to (2 - t) / t times the template's: parts meet only templates within these bounds, by a join on
the size with the small table of sizes and templates. Bigrams are made of parts with a candidate only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.llm.words import UPPER, ascii_lower, text_of
from scoremill.session import local_table

THRESHOLD = 0.8

# Usual notices, and passages of licence texts and of their recommended headers.
TEMPLATES = (
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT notice", "Released under the MIT License."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("BSD notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "Apache-2.0 header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "GPL-3.0 header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "ISC permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
)


def normalised(text: str) -> str:
    low = text.translate(str.maketrans(UPPER, UPPER.lower()))
    return re.sub(r"[^a-z0-9]+", " ", low).strip()


def bigrams(text: str) -> Counter:
    words = normalised(text).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams with which a part can reach the threshold against ``n``."""
    share = threshold / (2 - threshold)
    return max(1, math.ceil(n * share - 1e-9)), math.floor(n / share + 1e-9)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, number, content) for the normalised lines, paragraphs and whole texts; blank ones are left out."""
    flat = F.regexp_replace(ascii_lower(text_of("text")), r"[^a-z0-9\n]+", " ")
    several = lambda c: F.contains(c, F.lit("\n"))

    def numbered(kind: str, contents: Column) -> Column:
        return F.transform(
            contents, lambda c, i: F.struct(F.lit(kind).alias("part"), (i + 1).alias("number"), c.alias("content"))
        )

    joined = lambda c: F.regexp_replace(c, r"[ \n]+", " ")
    none = F.array().cast("array<struct<part:string,number:int,content:string>>")
    flat_docs = docs.select("doc_id", flat.alias("flat"))
    paragraphs = F.filter(
        numbered("paragraph", F.split("flat", r"\n(?: ?\n)+")), lambda p: several(F.trim(p["content"], F.lit(" \n")))
    )
    paragraphs = F.transform(
        paragraphs, lambda p: F.struct(p["part"].alias("part"), p["number"].alias("number"), joined(p["content"]).alias("content"))
    )
    units = F.concat(
        numbered("line", F.split("flat", "\n")),
        F.when(several(F.col("flat")), F.concat(paragraphs, numbered("text", F.array(joined(F.col("flat")))))).otherwise(none),
    )
    exploded = flat_docs.select("doc_id", F.explode(units).alias("u")).select(
        "doc_id", "u.part", "u.number", F.trim("u.content").alias("content")
    )
    return exploded.where("content <> ''")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per part and template that reach the threshold: doc_id, part, number, template, n_words, dice.

    ``part`` is line, paragraph or text and ``number`` its place among all of its kind, from 1. Needs doc_id and
    text; extra columns are ignored, a null text is empty and has no row, repeated rows give repeated results, a tie
    between templates gives a row each. Templates of fewer than two words are refused.
    """
    spark = docs.sparkSession
    counted = {name: bigrams(text) for name, text in templates}
    if not all(counted.values()):
        raise ValueError("a template needs two words")
    sizes, grams = [], []
    for name, counts in counted.items():
        n = sum(counts.values())
        low, high = size_bounds(n, threshold)
        sizes += [(size, name, n) for size in range(low, high + 1)]
        grams += [(name, gram, count) for gram, count in counts.items()]
    sizes = local_table(spark, sizes, "size bigint, template string, n_template bigint")
    grams = (
        local_table(spark, grams, "of string, gram string, n int")
        .groupBy("of")
        .agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("grams"))
    )
    # Blanks are single: the bigrams of a part are as many as its blanks.
    blanks = F.length("content") - F.length(F.replace("content", F.lit(" "), F.lit("")))
    candidates = parts(docs).withColumn("n_part", blanks.cast("bigint")).join(
        F.broadcast(sizes), F.col("n_part") == F.col("size")
    )  # both tables follow from the templates alone
    words = F.split("content", " ")
    paired = F.transform(
        F.sequence(F.lit(0), F.size("words") - 2),
        lambda i: F.concat(F.get("words", i), F.lit(" "), F.get("words", i + 1)),
    )
    weighed = (
        candidates.withColumn("words", words)
        .withColumn("pairs", paired)
        .join(F.broadcast(grams), F.col("template") == F.col("of"))
        .withColumn("common", F.array_intersect("pairs", F.map_keys("grams")))
        .where(F.size("common") > 0)
    )
    both = F.aggregate(
        "common",
        F.lit(0),
        lambda total, g: total
        + F.least(F.element_at("grams", g), F.size(F.filter(F.col("pairs"), lambda p: p == g))),
    )
    dice = (F.lit(2.0) * both) / (F.col("n_part") + F.col("n_template"))
    return (
        weighed.withColumn("dice", dice)
        .where(F.col("dice") >= threshold)
        .select("doc_id", "part", "number", "template", (F.col("n_part") + 1).alias("n_words"), "dice")
    )


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan as SQL of another engine, over the table documents; every part meets every template there."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(
        f"({quote(name)}, {quote(g)}, {c}, {sum(counts.values())})"
        for name, counts in ((n, bigrams(t)) for n, t in templates)
        for g, c in counts.items()
    )
    return rf"""
WITH flat AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^a-z0-9\n]+', ' ', 'g') AS f
  FROM documents),
units AS (
  SELECT r, doc_id, 'line' AS part, unnest(string_split(f, chr(10))) AS c,
         generate_subscripts(string_split(f, chr(10)), 1) AS number FROM flat
  UNION ALL
  SELECT * FROM (
    SELECT r, doc_id, 'paragraph', unnest(string_split_regex(f, '\n(?: ?\n)+')) AS c,
           generate_subscripts(string_split_regex(f, '\n(?: ?\n)+'), 1) FROM flat WHERE contains(f, chr(10)))
  WHERE contains(trim(c, ' ' || chr(10)), chr(10))
  UNION ALL
  SELECT r, doc_id, 'text', f, 1 FROM flat WHERE contains(f, chr(10))),
w AS (SELECT r, doc_id, part, number, string_split(trim(regexp_replace(c, '[ \n]+', ' ', 'g')), ' ') AS words FROM units),
g AS (SELECT r, doc_id, part, number, len(words) AS n_words, words[i] || ' ' || words[i + 1] AS gram
      FROM w, unnest(range(1, len(words))) AS t(i)),
counted AS (SELECT r, doc_id, part, number, n_words, gram, count(*) AS n FROM g GROUP BY ALL),
t(template, gram, n, size) AS (VALUES {rows}),
shared AS (
  SELECT r, doc_id, part, number, n_words, template, t.size, sum(least(counted.n, t.n)) AS common
  FROM counted JOIN t USING (gram) GROUP BY ALL),
scored AS (SELECT *, 2.0::DOUBLE * CAST(common AS BIGINT) / (n_words - 1 + size) AS dice FROM shared)
SELECT doc_id, part, CAST(number AS INTEGER) AS number, template, n_words, dice FROM scored WHERE dice >= {threshold}"""
