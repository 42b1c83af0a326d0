"""Near duplicates against brute force, with hot groups, and odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoremill.llm import neardup
from scoremill.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(docs):
    """doc_id -> (set size, component), every pair that shares a shingle compared."""
    sets = {i: shingles(t) for i, t in docs}
    lists = {}
    for i, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in lists[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, docs):
    found = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = brute_force(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_shingle_hashes_follow_words():
    texts = ["One two\tthree  four\nfive six", "one TWO three four five six", "a b", "a b ", "", " ", "b", "é\x0bf", "x" * 99]
    data, starts = neardup.bytes_of(neardup.pa.array(texts))
    sets = neardup.shingle_sets(data, starts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all()
    values = [int(v) for s in (sets[0], *sets[2:3], *sets[6:]) for v in s]
    assert len(set(values)) == len(values)


def test_whole_table_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows])


def group(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        yield " ".join(w)


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 8)
    rng = random.Random(3)
    texts = ["same text of a very large group of copies"] * 300
    texts += group(rng, [f"w{i}" for i in range(120)], 250, 5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"r{rng.random()}" for _ in range(rng.randint(5, 60))) for _ in range(150)]
    texts += group(rng, [f"long{i}" for i in range(900)], 40, 30)
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_estimate_is_exact_for_small_sets():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 32, 100, dtype=np.uint32))
    more = lambda k: rng.integers(0, 1 << 32, k, dtype=np.uint32)
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], more(k)])) for k in range(30)]
    size = np.array([len(s) for s in sets])
    got, sure = neardup._weigh(sets, sets, size, size)
    assert (got | ~sure).all() and sure.diagonal().all()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if both / (len(a) + len(b) - both) >= 0.75:
                assert got[i, j]


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(30000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "A  b", "x"), (4, "A  b", "x"), (None, "a b", "x")]
    rows += [(7, long, "x"), (8, long + " end", "x"), (None, "only here and now ok", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    out = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert out == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (0, 1, 3, False)]
        + [(7, 29996, 7, True), (8, 29997, 7, False), (0, 1, None, True)],
        key=repr,
    )
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 7]


def test_every_row_decides_for_itself(spark):
    copied = " ".join(f"w{i}" for i in range(40))
    rows = [(1, copied, "first"), (None, copied, "x"), (None, copied + " more", "x"), (None, "another text of its own here", "alone")]
    rows += [(2, copied, "x"), (2, "the second text has words of its own", "own"), (5, None, "no text"), (5, "", "empty"), (5, "", "empty")]
    rows += [(None, "another  text of its own here", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set string").withColumn("doc", F.lit(0)).withColumn("id", F.lit("c"))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["set"] for r in kept.collect()) == ["alone", "empty", "first", "no text", "own"]


@pytest.mark.parametrize("operator", [neardup.near_duplicates, neardup.keep_one])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {(r["node"], r["label"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
