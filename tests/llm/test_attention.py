"""Attention scores: gradients by differences, windows against plain loops, base scores by brute force, held-out gain."""

import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scoremill.llm import attention as at

needs_files = pytest.mark.skipif(not os.path.exists(at.MODEL), reason="needs the public vocabulary")
SCHEMA = "doc_id long, text string, block string, slot string"


def counts_of(texts, vocabulary):
    ids, lengths = flat(texts)
    seen = np.bincount(ids, minlength=vocabulary).astype(float)
    class_of, share = at.classes(seen)
    n = at.SINGLE + at.SHARED
    before = np.concatenate([[at.START], ids[:-1]])
    before[np.cumsum(lengths) - lengths] = at.START
    pairs = np.bincount(before * n + class_of[ids], minlength=vocabulary * n).reshape(vocabulary, n)
    return at.Counts(class_of, share, at.after(pairs.astype(float), class_of, seen))


def flat(texts):
    return np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts])


def random_layer(vocabulary, rng, kind=np.float64):
    layer = at.Layer.start(vocabulary, at.SINGLE + at.SHARED)
    layer.out[:] = rng.normal(0, 0.5, layer.out.shape)
    layer.distance[:] = rng.normal(0, 0.5, layer.distance.shape)
    return at.Layer(*(x.astype(kind) for x in layer.arrays()))


def texts_of(rng, vocabulary, lengths):
    return [np.concatenate([rng.integers(3, vocabulary, n - 1), [at.END]]) if n else np.zeros(0, np.int64) for n in lengths]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    texts = texts_of(rng, 50, [1, 70, 0, 79])
    counts, layer = counts_of(texts, 50), random_layer(50, rng)
    w = next(at.windows(*flat(texts), 50))
    _, rows, grads = at.gradients(layer, counts, w)
    for number, (x, g) in enumerate(zip(layer.arrays(), grads)):
        for _ in range(6):
            place = tuple(int(rng.integers(0, n)) for n in g.shape)
            where = (int(rows[place[0]]), *place[1:]) if number == 0 else place
            if where[0] == 50 and number == 0:
                continue
            kept, sides = x[where], []
            for step in (1e-4, -1e-4):
                x[where] = kept + step
                sides.append(at.gradients(layer, counts, w)[0])
            x[where] = kept
            assert abs((sides[0] - sides[1]) / 2e-4 - g[place]) < 1e-6


def plain_score(text, layer, counts):
    """One position after the other, with the context its window has."""
    total, seq = 0.0, [at.START, *text[:-1]]
    for p, target in enumerate(text):
        low = max(0, p - p % at.STEP - at.STEP)
        x = layer.embed[seq[p]]
        s = [x @ layer.query @ (layer.embed[seq[j]] @ layer.key) / math.sqrt(at.WIDTH) + layer.distance[p - j] for j in range(low, p + 1)]
        w = np.exp(np.array(s) - max(s))
        a = sum(wi * (layer.embed[seq[j]] @ layer.value) for wi, j in zip(w / w.sum(), range(low, p + 1)))
        logits = np.tanh(x + a) @ layer.out + counts.after[seq[p]]
        total += logits[counts.class_of[target]] - np.log(np.exp(logits).sum()) + counts.share[target]
    return total / math.log(10)


def test_windows_score_each_id_once():
    rng = np.random.default_rng(1)
    texts = texts_of(rng, 200, [1, 2, 31, 32, 33, 64, 65, 0, 200, 97])
    counts, layer = counts_of(texts, 200), random_layer(200, rng, np.float32)
    expected = [plain_score(t.tolist(), layer, counts) if len(t) else 0.0 for t in texts]
    assert np.allclose(at.Scorer(layer, counts).score(*flat(texts)), expected, rtol=1e-4)


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    texts = texts_of(rng, 300, [40, 60])
    counts, layer = counts_of(texts, 300), random_layer(300, rng, np.float32)
    start = texts[0][:35].tolist()
    scorer = at.Scorer(layer, counts)
    before = scorer.score(*flat([start]))[0]
    nexts = scorer.score(*flat([[*start, i] for i in range(300)]))
    assert abs(np.sum(10 ** (nexts - before)) - 1) < 1e-3


def test_attention_learns_what_counts_cannot():
    """The id five places back comes again: of no use to counts after one id."""
    rng = np.random.default_rng(3)

    def made(n):
        out = []
        for _ in range(n):
            seq = rng.integers(3, 60, 5).tolist()
            while len(seq) < 120:
                seq.append(seq[-5] if rng.random() < 0.95 else int(rng.integers(3, 60)))
            out.append(np.array([*seq, at.END]))
        return out

    learned, held = made(1500), made(40)
    counts = counts_of(learned, 100)
    start = at.Layer.start(100, at.SINGLE + at.SHARED)
    ids, lengths = flat(held)
    before = at.Scorer(start, counts).score(ids, lengths).sum() / len(ids)
    layer = start
    for _ in range(3):
        layer, _ = at.train(layer, counts, *flat(learned))
    after = at.Scorer(layer, counts).score(ids, lengths).sum() / len(ids)
    assert after > before + 0.3, (before, after)


def brute_base(rows):
    def tokens(t):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = c.total(), len(c)
    return [
        (i, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        for (i, t), h in zip(rows, held)
    ]


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    return at.score(docs, **more).collect()


@needs_files
def test_base_scores_and_odd_rows(spark):
    texts = [None, "", " \n ", "The the THE", "É é", "x" * 500, "x" * 500 + " y", "日本 🙂", "a\x00b", "word " * 3000, "unseen"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "the null id"), (2, "twice"), (2, "twice")]
    got = found(spark, rows, rounds=1)
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    expected = sorted(brute_base(rows), key=key)
    assert len(got) == len(rows)
    for g, e in zip(sorted((tuple(r) for r in got), key=key), expected):
        assert g[:5] == e[:5] and math.isclose(g[5], e[5], rel_tol=1e-9) and g[6] < 0 and math.isfinite(g[6])
    same = {(r.n_tokens, round(r.base_score, 6)): set() for r in got}
    for r in got:
        same[r.n_tokens, round(r.base_score, 6)].add(round(r.score, 3))
    assert all(len(s) == 1 for k, s in same.items() if k[0] in (3001,))


@needs_files
def test_empty_table(spark):
    assert found(spark, []) == []


@needs_files
def test_base_scores_of_the_shared_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the shared test tables")
    docs = spark.read.parquet(path)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in at.score(docs).collect()}
    for e in brute_base(rows):
        g = tuple(got[e[0]])
        assert g[:5] == e[:5] and math.isclose(g[5], e[5], rel_tol=1e-9)


@needs_files
def test_training_helps_held_out_texts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the shared test tables")
    docs = spark.read.parquet(path)
    score = lambda rounds: at.score(docs, rounds=rounds).where("held_out").agg({"score": "sum"}).first()[0]
    assert score(10) > score(0)


def test_parameters_are_averaged_by_weight(spark):
    layer = at.Layer.start(5, 3)
    rows = [(n, float(n), (np.full(sum(x.size for x in layer.arrays()), n, np.float32)).tobytes()) for n in range(1, 40)]
    level = spark.createDataFrame([(n, w, bytearray(raw)) for n, w, raw in rows], at.PARAMETERS)
    top = at._mean(at._mean(level)).collect()
    assert len(top) == 1 and top[0]["weight"] == sum(range(1, 40))
    mean = layer.like(bytes(top[0]["raw"]))
    assert np.allclose(mean.query, sum(n * n for n in range(1, 40)) / sum(range(1, 40)), rtol=1e-5)


def test_every_training_document_teaches_the_layer(spark):
    """An id that only one document holds moves, whatever share of the documents that one falls into."""
    texts = [np.array([3 + s] * 40 + [at.END]) for s in range(at.SLOTS)]
    counts = counts_of(texts, 100)
    rows = [(s, False, s, t.tolist()) for s, t in enumerate(texts)] + [(99, True, 7, [90] * 40 + [at.END]), (None, None, None, None)]
    read = spark.createDataFrame(rows, "doc_id long, held_out boolean, slot int, ids array<short>").repartition(3)
    moved = np.abs(at.fit(read, counts, 4).embed - at.Layer.start(100, at.SINGLE + at.SHARED).embed).max(1) > 0
    # before the first step the output is zero, so the first round's documents may leave their ids alone
    assert all(moved[3 + s] for s in range(at.SLOTS) if s % 4) and not moved[90]
    assert not at.fit(read, counts, 0).out.any() and at.fit(read.where("held_out"), counts, 4).out.max() == 0


@needs_files
def test_chunks_are_tokenized_as_whole_texts():
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "▁", "a", "the", "ing", "é", "日本", "🙂", "\x00", "1", ".", "<s>", "the house"]
    texts = ["", " ", "\n", "\nabc", " abc  \n", "▁", "x▁ y"] + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(400)]
    pieces = at._pieces(at.MODEL)
    for t in texts:
        assert [i for ids in pieces.encode_chunks(at.chunks(t)) for i in ids] == (pieces.encode(t).tolist() if t else []), repr(t)


def test_memory_does_not_grow_with_a_batch(monkeypatch):
    """Many ids in one Arrow batch: every step works on a part of them at a time."""
    rng = np.random.default_rng(5)
    texts = texts_of(rng, 100, [1000] * 4000)
    ids, lengths = flat(texts)
    counts = counts_of(texts[:100], 100)
    layer = at.Layer.start(100, at.SINGLE + at.SHARED)
    monkeypatch.setattr(at, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    lists = pa.record_batch({"ids": pa.ListArray.from_arrays(ends, pa.array(ids, pa.int16()))})
    packed = pa.record_batch({"ids": at._packed(ids.astype(np.int16), lengths)})
    small = lists.slice(0, 400)
    del texts, ids
    for work in (at._scoring(layer, counts), at._trainer(layer, counts), at._pairing(counts.class_of)):
        for batch in (lists, packed) if work.__name__ == "work" else (lists,):
            tracemalloc.start()
            for _ in work(iter([batch])):
                pass
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            # the ids alone take 32 MB as int64
            assert peak < 45e6, (work.__name__, peak)
    found = [next(at._scoring(layer, counts)(iter([b]))).column("score").to_numpy() for b in (small, packed.slice(0, 400), packed.slice(100, 300))]
    assert np.allclose(found[0], found[1], rtol=1e-6) and np.allclose(found[0][100:], found[2], rtol=1e-6)


def test_parts_of_texts():
    lengths = np.array([0, 3, 5, 0, 20, 1, 1, 0])
    found = list(at.parts(np.arange(30), lengths, 8))
    assert [n.tolist() for _, n in found] == [[0, 3, 5, 0], [20], [1, 1, 0]]
    assert np.concatenate([i for i, _ in found]).tolist() == list(range(30))
    assert list(at.parts(np.arange(0), np.zeros(0, np.int64))) == []


def test_chunks_of_many_texts():
    rng = np.random.default_rng(6)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "a", "THE", "\u00c9", "\u65e5\u672c", "\x00", ".", "x" * 70]
    texts = ["", " ", "\n", " \n a", "b\n\n c ", *("".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)), ""]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    for more in ([], ["a \u2581 b", " x\u2581"]):
        found, which, lengths = at.distinct_chunks([t.encode() for t in texts + more])
        assert len(set(found)) == len(found)
        ends = np.cumsum(lengths)
        assert [[found[i] for i in which[e - n : e]] for n, e in zip(lengths, ends)] == [at.chunks(t) for t in lower + more]
    assert at.distinct_chunks([b"", b""])[2].tolist() == [0, 0]


@needs_files
def test_blocks_in_parts_hold_what_one_part_holds(monkeypatch):
    """Words are listed once for a block, whatever its parts; a block that is full is followed by another."""
    texts = ["the house and the house", None, "a new word", "", "the end", "a new house"] * 4
    docs = pa.record_batch({"doc_id": range(len(texts)), "text": texts, "held_out": [i % 5 == 1 for i in range(len(texts))], "slot": pa.array([0] * len(texts), pa.int32())})
    monkeypatch.setattr(at.blocks, "numbers", lambda: iter(range(100)))
    rows = lambda size: pa.Table.from_batches(at.read(iter([docs.slice(i, size) for i in range(0, len(texts), size)]), at.MODEL)).to_pylist()
    lists = lambda found: [r for r in found if r["word"]]
    ids = lambda found: [r["ids"] for r in found if r["ids"] is not None]
    one, many = rows(24), rows(5)
    assert lists(one) == lists(many) and len(lists(one)) == 1 and ids(one) == ids(many)
    assert [r["row"] for r in many if r["ids"] is not None] == list(range(24))
    monkeypatch.setattr(at, "KINDS", 4)
    cut = rows(6)
    assert [r["block"] for r in lists(cut)] == [0, 1, 2, 3] and ids(cut) == ids(one)
    assert sum(sum(r["n"]) for r in lists(cut)) == sum(lists(one)[0]["n"])
