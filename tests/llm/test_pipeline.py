"""Every stage of the pipeline against plain Python on its own input, and the whole on odd rows."""

import re
from collections import Counter

import corpus_pipeline
from test_neardup import brute_force
from test_secrets import base_spans, entropy_spans

from scoremill.llm import mixing
from scoremill.session import stage

SF_DIR = "/root/testdata/sf0.01"


def masked(text):
    spans = sorted((a, b) for a, _, b in base_spans(text) + entropy_spans(text))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "secrets", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    known = stage(steps["language"](spark, docs, SF_DIR))
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in known.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}

    single = stage(steps["near_duplicates"](spark, known, SF_DIR))
    groups = brute_force([(r["doc_id"], r["text"]) for r in known.collect()])
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)

    clean = stage(steps["secrets"](spark, single, SF_DIR))
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts == {r["doc_id"]: masked(r["text"]) for r in single.collect()}
    assert any("[SECRET]" in t for t in texts.values())

    mixed = stage(steps["mixing"](spark, clean, SF_DIR))
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies and set(copies.values()) <= {1, 2}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed.collect())

    encoded = steps["pieces"](spark, mixed, SF_DIR)
    assert Counter(r["doc_id"] for r in encoded.collect()) == copies
    assert encoded.where("NOT round_trip").count() == 0


def test_mix_follows_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert all(r["size"] == words[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - 1.5 * sum(words.values())) < 1e-6 * sum(words.values())
    assert sorted(map(repr, out)) == sorted(repr(r.asDict()) for r in mixing.mix(docs).collect())


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 1), (3, "x y", None, 1), (3, "x y", None, 1), (None, "one two three", "b", 1)]
    rows += [(i, "w " * (i % 9), "hot", 1) for i in range(10, 400)] + [(500, "z " * 50000, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2 for r in out)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    empty = docs.where("doc_id < 0")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = docs.where("text = ''")
    assert {r["target"] for r in mixing.mix(blank).collect()} == {0.0}


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "12 34", "en", "a"), (4, "the cat is here now and then", None, None)]
    rows += [(i, f"the cat number {i} is here and sleeps for {i} days token=abcdef{i}", "en", "a") for i in range(10, 30)]
    rows += [(5, "the cat is here now and then", "en", "b")] * 2 + [(None, "le chat est là et dort encore", "fr", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids and ids.isdisjoint({1, 2, 3, 5}) and all(r["round_trip"] for r in out)
    docs.where("doc_id < 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
