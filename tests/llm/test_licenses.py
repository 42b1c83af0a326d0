"""Licence scan against plain Python and its SQL twin."""

import re
from pathlib import Path

import pytest

from scoremill.llm import licenses

SF_DIR = Path("/root/testdata/sf0.01")


def plain(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    flat = re.sub(r"[^a-z0-9\n]+", " ", (text or "").translate(str.maketrans(licenses.UPPER, licenses.UPPER.lower())))
    units = [("line", i, c) for i, c in enumerate(flat.split("\n"), 1)]
    if "\n" in flat:
        paragraphs = re.split(r"\n(?: ?\n)+", flat)
        units += [("paragraph", i, c) for i, c in enumerate(paragraphs, 1) if "\n" in c.strip(" \n")]
        units.append(("text", 1, flat))
    for part, number, content in units:
        mine = licenses.bigrams(content)
        for name, template in templates:
            theirs = licenses.bigrams(template)
            size = sum(mine.values()) + sum(theirs.values())
            dice = 2 * sum((mine & theirs).values()) / size
            if dice >= threshold:
                yield part, number, name, sum(mine.values()) + 1, dice


TEXTS = [
    None,
    "",
    "\n\n",
    "prose\nReleased under the MIT license\n\nmore",
    "released under MIT the license",
    dict(licenses.TEMPLATES)["MIT permission"].replace(", ", ",\n").upper(),
    "a\n \nLicensed under the Apache License,\nVersion 2.0.\n\n\n" + dict(licenses.TEMPLATES)["GPL-3.0 header"],
    "under under under under under the MIT license license",
    ("word " * 40 + "\n") * 2000 + "Licensed under CC BY-NC 4.0.",
]


def test_matches_plain_python(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    found = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=repr)
    wanted = sorted(((i, *m) for i, t, _ in rows for m in plain(t)), key=repr)
    assert found == wanted and len(found) > 6


def test_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = licenses.size_bounds(n, 0.8)
        fits = [m for m in range(1, 200) if 2 * min(m, n) / (m + n) >= 0.8]
        assert (low, high) == (fits[0], fits[-1])


def test_empty_table_and_short_template(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, (("x", "one"),))
