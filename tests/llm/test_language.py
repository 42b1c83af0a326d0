"""Code lengths against a plain coder, held-out accuracy, and odd inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoremill.llm import language


def plain_bits(text, teaching, order=language.ORDER):
    """Prediction by partial matching, byte by byte, over the texts of one language."""
    seen = defaultdict(Counter)
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    for t in teaching:
        data = [None] * order + list(low(t))
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[tuple(data[i - k : i])][data[i]] += 1
    bits, data = 0.0, [None] * order + list(low(text))
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            counts = seen.get(tuple(data[i - k : i]))
            if counts is None:
                continue
            n, q = sum(counts.values()), len(counts)
            if data[i] in counts:
                bits -= math.log2(counts[data[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


TEACHING = {"a": ["the cat sat", "A cat thing", "x"], "b": ["le chat était", "çà et là", "un"]}


@pytest.fixture(scope="module")
def model():
    batches = []
    for lang, texts in TEACHING.items():
        rows = pa.RecordBatch.from_pydict({"lang": [lang] * len(texts), "text": texts})
        batches += [b.to_pandas() for b in language._grams([rows])]
    grams = pd.concat(batches).groupby(["lang", "gram"], as_index=False)["seen"].sum()
    return language.build(grams, ("a", "b"))


def test_code_lengths_are_exact(model):
    texts = ["the chat", "é", "", "zzz ☃ q", "THE CAT SAT " * 50, "x", "un", "ça"]
    bits = language.code_lengths(pa.array(texts), model)
    for row, text in zip(bits, texts):
        assert row == pytest.approx([plain_bits(text, TEACHING[lang]) for lang in ("a", "b")], rel=1e-5)


def test_pieces_do_not_matter(model, monkeypatch):
    texts = pa.array(["the cat", "", "le chat était là", "x", "", "un chat"])
    whole = language.code_lengths(texts, model)
    monkeypatch.setattr(language, "PIECE", 3)
    assert np.allclose(whole, language.code_lengths(texts, model))


def test_many_languages_and_bytes_lose_no_context():
    """30 languages over many bytes: every context of three bytes is kept."""
    rng = random.Random(2)
    letters = "".join(chr(c) for c in range(97, 123)) + "äöüßéèñçøåабвгд "
    teaching = {f"l{i:02d}": ["".join(rng.choices(letters, k=400)) for _ in range(4)] for i in range(30)}
    rows = pa.RecordBatch.from_pydict(
        {"lang": [k for k, v in teaching.items() for _ in v], "text": [t for v in teaching.values() for t in v]}
    )
    grams = pd.concat([b.to_pandas() for b in language._grams([rows])])
    model = language.build(grams.groupby(["lang", "gram"], as_index=False)["seen"].sum(), tuple(sorted(teaching)))
    assert len(model.orders[-1].strings) == grams["gram"].nunique()
    texts = [teaching["l07"][1][50:200], "zß☃ и"]
    bits = language.code_lengths(pa.array(texts), model)
    for row, text in zip(bits, texts):
        assert row == pytest.approx([plain_bits(text, teaching[k]) for k in sorted(teaching)], rel=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, low, high = found.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")
    ).first()
    assert n > 100 and right > 0.97 and 0 <= low and high <= 1


def test_odd_rows(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s") for i, t in enumerate(["le chat est là", "the cat is there"] * 20)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 + 3", "en", "s"), (None, "the cat", None, "s")]
    rows += [(103, "the cat is there " * 5000, "en", "s"), (103, "the cat is there " * 5000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language.identify(docs).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert by_id[103]["lang_pred"] == by_id[None]["lang_pred"] == "en" and by_id[None]["held_out"] is False
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert kept.where("doc_id IS NULL").first()["lang"] == "en"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(docs).count() == 0
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(one).first()["lang_pred"] == "und"
