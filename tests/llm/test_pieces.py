"""N-best segmentation against all segmentations, exact round trips, and odd inputs."""

import heapq
import itertools
import os
import random
import tracemalloc

import pytest

from scoremill.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def all_costs(chunk, v):
    """Costs of all segmentations, cheapest first."""
    paths = {0: [0]}
    for end in range(1, len(chunk) + 1):
        here = []
        for start in range(max(0, end - v.longest), end):
            piece = v.pieces.get(chunk[start:end])
            if piece or end - start == 1:
                here += [c + (piece[1] if piece else v.spelt) for c in paths[start]]
        paths[end] = here
    return sorted(paths[len(chunk)])


CHUNKS = [" the", "   Hello", "aaaaaaaa", " wörld", "x", " ", "☃☃", " thation", "\n", " 日本語です", "▁a"]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_chunk_n_best(vocabulary, chunk):
    costs = all_costs(chunk, vocabulary)
    found = pieces.n_best(chunk, 12, vocabulary)
    assert [c for c, _ in found] == costs[:12]
    assert len({tuple(i) for _, i in found}) == len(found)
    ids, cost, more = pieces.best_of(chunk, vocabulary)
    assert found[0] == (cost, ids)
    assert more == (costs[1] - costs[0] if len(costs) > 1 else None)
    for _, i in found:
        assert b"".join(vocabulary.text[x] for x in i).decode() == chunk


def test_many_chunks_at_once(vocabulary, monkeypatch):
    rng = random.Random(3)
    chunks = [" " + "".join(rng.choice("abet ☃éz_1A"[:k]) for _ in range(rng.randint(0, 40))) for k in (3, 9, 11) for _ in range(150)]
    chunks += [*CHUNKS, "ist", " ist", "\x00", "\ud800"]
    monkeypatch.setattr(pieces, "TOGETHER", 64)
    assert pieces.best_of_many(chunks, vocabulary) == [pieces.best_of(c, vocabulary) for c in chunks]
    assert pieces.best_of_many([], vocabulary) == []


def test_blank_stays_with_its_word(vocabulary):
    ids, _, _ = pieces.best_of(" ist", vocabulary)
    assert ids == [vocabulary.pieces[" ist"][0]]


def test_about_as_many_pieces_as_merging_gives(spark):
    import sentencepiece

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    merged = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode([t or "" for t in texts])
    found = pieces.Encoder(pieces.load()).encode([t or "" for t in texts])[0]
    assert len(found) == pytest.approx(sum(map(len, merged)), rel=0.05)


def test_long_text_without_blanks(vocabulary):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij") for _ in range(150_000))
    tracemalloc.start()
    ids, _, scores, others = pieces.Encoder(vocabulary).encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(vocabulary.text[i] for i in ids.tolist()).decode() == f" {text}"
    assert len(others[0]) == pieces.BEST - 1 and all(o["score"] <= scores[0] for o in others[0])
    assert all(len(e["ids"]) < 50 for e in others[0][0]["edits"])
    assert peak < 200 * len(text)


def price(ids, v):
    by_id = {i: c for i, c in v.pieces.values()}
    out, spelt = 0, b""
    for i in ids:
        if i in by_id:
            out += by_id[i]
        else:
            spelt += v.text[i]
    return out + v.spelt * len(spelt.decode())


@pytest.mark.parametrize("text", ["the cat sat on the mat", "a  b\nc", "été ☃ là", "to to to to", "x"])
def test_text_n_best(vocabulary, text):
    n = 6
    chunks = pieces.CHUNKS.findall(f" {text}")
    parts = [[c for c in all_costs(x, vocabulary)[:n]] for x in chunks]
    wanted = heapq.nsmallest(n, (sum(p) for p in itertools.product(*parts)))
    ids, starts, scores, others = pieces.Encoder(vocabulary, n).encode([text])
    got = [round(-scores[0] * pieces.UNIT)] + [round(-o["score"] * pieces.UNIT) for o in others[0]]
    assert got == wanted and list(starts) == [0, len(ids)]
    for o, cost in zip(others[0], wanted[1:]):
        edited = ids.tolist()
        for e in sorted(o["edits"], key=lambda e: -e["at"]):
            edited[e["at"] : e["at"] + e["drop"]] = e["ids"]
        assert price(edited, vocabulary) == cost
        assert b"".join(vocabulary.text[i] for i in edited).decode() == f" {text}"


def test_cache_size_does_not_matter(vocabulary, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "thing", "là", "☃", "word"]) for _ in range(30)) for _ in range(20)]
    whole = pieces.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(pieces, "CACHED", 1)
    small = pieces.Encoder(vocabulary)
    assert [small.encode([t])[2:] for t in texts] == [([s], [o]) for s, o in zip(*whole[2:])]


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pieces.encode(docs)
    assert out.where("NOT round_trip").count() == 0
    assert out.where(f"size(others) = {pieces.BEST - 1} AND others[0].score <= score").count() > 900


def test_odd_rows(spark, vocabulary):
    texts = [None, "", " ", "\n\n", "  two  blanks ", "▁ literal", "z" * 30000, "tab\there", "\u0000", "🎉" * 50]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "\n\n", 1)], "doc_id long, text string, ids int")
    rows = pieces.encode(docs).collect()
    assert len(rows) == len(texts) + 1 and all(r["round_trip"] for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["ids"] == by_id[1]["ids"] == [] and by_id[0]["score"] == 0 and by_id[0]["others"] == []
    assert pieces.encode(docs.where("doc_id < 0")).count() == 0


def test_encoding_and_decoding_share_a_process(spark):
    """A second function would run in a Python process of its own, beside the first one in every task."""
    docs = spark.createDataFrame([(1, "a  b"), (2, None), (3, "")], "doc_id long, text string")
    out = pieces.encode(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["round_trip"] for r in out.collect()] == [True] * 3
