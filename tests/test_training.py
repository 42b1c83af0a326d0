"""Contamination, prefix sums, packing, rules, best shares and token shards against plain Python, with odd rows."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scoremill.operators import contamination, quality, sequences
from scoremill.sources import token_shards

DOCS = "doc_id long, text string, _id string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(4)


def grams(text, n):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def random_texts(rng, n, words):
    return [" ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def tainted():
    rng = random.Random(4)
    items = [(i, t) for i, t in enumerate(random_texts(rng, 12, ["Alpha", "beta", "GAMMA", "d4"]))] + [(3, "beta d4 beta"), (None, "alpha alpha d4"), (99, None)]
    docs = list(enumerate(random_texts(rng, 60, ["alpha", "Beta", "gamma", "d4", "é"])))
    docs += [(None, docs[5][1]), (None, "clean words only here"), (7, "clean again"), (8, None), (9, ""), (docs[5][0], docs[5][1])]
    docs.append((200, "filler " * 50_000 + "alpha beta gamma d4 " * 5))
    return docs, items


@pytest.mark.parametrize("slots", [1 << 17, 4])
def test_contamination(spark, tainted, monkeypatch, slots):
    monkeypatch.setattr(contamination, "SLOTS", slots)
    docs, items = tainted
    of_items, of_docs = defaultdict(set), defaultdict(set)
    for i, t in items:
        of_items[i] |= grams(t, 3)
    for i, t in docs:
        of_docs[i] |= grams(t, 3)
    expected = {(i, j): (len(x & y), len(y)) for i, x in of_docs.items() for j, y in of_items.items() if x & y}
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contamination(docs_of(spark, docs), frame, 3).collect()
    assert {(r.doc_id, r.item_id): (r.hits, r.item_grams) for r in got} == expected and len(got) == len(expected)
    assert all(r.ratio == r.hits / r.item_grams for r in got)


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_decontaminate_by_row(spark, tainted, least):
    docs, items = tainted
    of_items = defaultdict(set)
    for i, t in items:
        of_items[i] |= grams(t, 3)
    clean = [r for r in docs if not any(len(grams(r[1], 3) & g) > least * len(g) for g in of_items.values() if g)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.decontaminate(docs_of(spark, docs), frame, 3, least)
    assert got.columns == ["doc_id", "text", "_id", "key"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(clean)
    nothing = frame.limit(0)
    assert contamination.decontaminate(docs_of(spark, docs), nothing).count() == len(docs)
    assert contamination.contamination(docs_of(spark, []), frame).count() == 0


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, None, 10**12])) for i in rng.sample(range(10_000), 3000)]
    got = {r.i: r.start for r in sequences.starts(spark.createDataFrame(rows, "i long, size long"), ["i"]).collect()}
    total = 0
    for i, n in sorted(rows):
        assert got[i] == total
        total += n or 0
    assert sequences.starts(spark.createDataFrame([], "i long, size long"), ["i"]).count() == 0


ODD = [(5, "abc"), (5, "abc"), (5, "xyz"), (None, "null id"), (None, "null id"), (1, ""), (2, None), (3, "é🙂ü"), (4, "long " * 5000)]


@pytest.mark.parametrize("tail", [False, True])
def test_pack_text(spark, tail):
    digest = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest() if t is not None else "null"
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    whole = "".join(t or "" for _, t in order)
    cut = [whole[k : k + 7] for k in range(0, len(whole), 7)]
    cut = [c for c in cut if tail or len(c) == 7]
    got = {r["sequence"]: r["value"] for r in sequences.pack(docs_of(spark, ODD), "text", 7, tail).collect()}
    assert got == dict(enumerate(cut))


def test_pack_tokens_and_shards(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 50]))]) for i in range(200)] + [(777, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<int>").repartition(5)
    whole = [x for _, t in rows for x in t or []]
    got = {r["sequence"]: r["value"] for r in sequences.pack(docs, "tokens", 16).collect()}
    assert got == {k: whole[k * 16 : k * 16 + 16] for k in range(len(whole) // 16)}
    laid = sequences.lay_out(docs.select("doc_id", F.lit("t").alias("text"), "tokens"), F.size("tokens"))
    held = defaultdict(list)
    for r in sequences.shards(laid, 100).collect():
        held[r["shard"]].append((r["start"], r["size"] or 0))
    for shard, parts in held.items():
        assert all(shard * 100 <= s < shard * 100 + 100 for s, _ in parts)
    assert sum(n for parts in held.values() for _, n in parts) == len(whole)


def test_empty_pack(spark):
    assert sequences.pack(docs_of(spark, []), "text", 4).count() == 0
    assert sequences.pack(docs_of(spark, [(1, None), (2, "")]), "text", 4, tail=True).count() == 0


def test_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,), ([1, 2, 3, 4, 5],)], "v array<int>")
    got = [r[0] for r in df.select(sequences.pad(F.col("v"), 4, F.lit(0))).collect()]
    assert got == [[1, 2, 3, 0], [0] * 4, [0] * 4, [1, 2, 3, 4]]


def test_rules(spark):
    rules = [("empty", F.col("text").isNull()), ("a", "text LIKE 'a%'"), ("kept out", "text LIKE '%b'")]
    docs = docs_of(spark, [(1, None), (2, "ab"), (3, "b"), (4, "c"), (None, "c")])
    rows, watch = quality.counted(quality.with_reason(docs, rules), rules)
    got = sorted((r.doc_id or 0, r.reason) for r in rows.collect())
    assert got == [(0, None), (1, "empty"), (2, "a"), (3, "kept out"), (4, None)]
    assert watch.get == {"kept": 2, "empty": 1, "a": 1, "kept out": 1}
    with pytest.raises(ValueError):
        quality.with_reason(docs, [("x", "true"), ("x", "false")])


def test_best_share(spark):
    rng = random.Random(6)
    scores = [0.0, 1.0, -1.5, 1e300, -1e300, 1e-300, None, float("nan"), float("inf"), 7.0]
    rows = [(i, rng.choice(["hot", "hot", "s", None]), rng.choice([*scores, rng.random(), float(rng.randrange(5))])) for i in range(900)]
    rows += [(2**62 + i, "big", 1.0) for i in range(50)] + [(None, "hot", 3.0), (-(2**62), "big", 1.0), (5, "one", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, score double").repartition(4)
    ranked = defaultdict(list)
    for i, s, v in rows:
        if i is not None and v is not None and math.isfinite(v):
            ranked[s].append((-v, i))
    for share in (0.0, 0.1, 0.37, 1.0):
        expected = {(s, i) for s, r in ranked.items() for _, i in sorted(r)[: math.ceil(share * len(r))]}
        got = quality.best_share(df, share)
        assert got.columns == df.columns
        assert {(r.source, r.doc_id) for r in got.collect()} == expected
    assert quality.best_share(df.limit(0), 0.5).count() == 0


def test_exact_copies(spark):
    rows = [(3, "a"), (1, "a"), (None, "a"), (2, "A"), (None, None), (7, None), (8, ""), (1, "a")] + [(10 + i, "hot") for i in range(200)]
    got = Counter(tuple(r) for r in quality.exact_copies(docs_of(spark, rows)).collect())
    texts = defaultdict(list)
    for i, t in rows:
        texts[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
    assert got == Counter((i, least[t], len(texts[t])) for i, t in rows)
    assert quality.exact_copies(docs_of(spark, [])).count() == 0


def test_token_shards_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(70_000) for _ in range(rng.choice([0, 2, 40, 400]))]) for i in range(300)] + [(None, [1]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>").repartition(3)
    path = f"file://{tmp_path}/shards"
    token_shards.write(df, path, 500)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(((i, t or []) for i, t in rows), key=key)
    assert sorted(((r.doc_id, list(r.tokens)) for r in token_shards.read(spark, path).collect()), key=key) == expected
    shards = token_shards.listed(path)
    assert all(s["tokens"] <= 500 for s in shards) and sum(s["docs"] for s in shards) == len(rows)
    # appended, then replaced
    token_shards.write(df.limit(1), path, 500)
    assert token_shards.read(spark, path).count() == len(rows) + 1
    token_shards.write(df.limit(2), path, 500, mode="overwrite")
    assert token_shards.read(spark, path).count() == 2


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/shards"
    good = spark.createDataFrame([(i, [i]) for i in range(50)], "doc_id long, tokens array<int>")
    bad = good.union(spark.createDataFrame([(99, [70_000])], good.schema))
    with pytest.raises(Exception, match="does not fit"):
        token_shards.write(bad.repartition(6), path, 10, dtype="uint16")
    assert token_shards.read(spark, path).count() == 0
    assert not [f for f in os.listdir(path) if f.endswith(".bin")]
    token_shards.write(good, path, 10, dtype="uint16")
    assert token_shards.read(spark, path).count() == 50
    with pytest.raises(Exception, match="dtype"):
        token_shards.write(good, path, 10, dtype="float")
