"""Alignment of tokenizers against whole-text tokenization and all pairs by brute force."""

import bisect
import hashlib
import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scoremill.llm import alignment, blocks

pytestmark = pytest.mark.skipif(not os.path.exists(alignment.A_FILE), reason="needs the public vocabularies")
SCHEMA = "doc_id long, text string, block string, n string"
ODD = [
    None, "", " ", "  ", "\n", "▁", "a▁b", "naïve café", "日本語のテキスト。", "🙂🙂🏽 ok", "x" * 5000, " " * 3000 + "a",
    "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01 a\tb\r\n", "It's they'll 'S", "é" * 700, "1234567890 12 3.5",
    "word " * 900, "tab\t\tand  two   blanks", "a b", "ﬁ ﬀ ²",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)


def brute(rows, tokenizers):
    """Rows of the result, from the whole texts and their sets of byte offsets."""
    a, b = tokenizers
    byte_of = alignment.byte_level()
    docs, held = [], Counter()
    for doc_id, text in rows:
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = list(itertools.accumulate(map(len, bytes_a)))
        ends_b = list(itertools.accumulate(map(len, bytes_b)))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = Counter(p for g in groups for p in itertools.product(*g))
        held.update(links.keys())
        docs.append((doc_id, ids_a, ids_b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in docs:
        form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(form.encode()).hexdigest() if groups else ""
        n_best = sum(n for p, n in links.items() if held[p] == best[p[0]])
        count_sum = sum(n * held[p] for p, n in links.items())
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), links.total(), n_best, count_sum, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in alignment.align(docs).collect()), key=repr)


def test_odd_texts(spark, tokenizers):
    rows = [*enumerate(ODD), (3, "naïve café"), (3, "naïve café"), (None, "a b"), (None, None)]
    assert found(spark, rows) == brute(rows, tokenizers)


def test_random_texts(spark, tokenizers):
    rng = random.Random(5)
    parts = ["the ", "Ünter", " ", "\n", "12", "’", "don't", "ing", "🙂", "漢", "x", "  ", "tion of", "\t", "é "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(400)))) for i in range(60)]
    rows += [(100, " ".join(rng.choices(["alpha", "beta", "re", "ß", "under-way", "x1"], k=3000)))]
    assert found(spark, rows) == brute(rows, tokenizers)


def test_shared_table(spark, tokenizers):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the shared test tables")
    docs = spark.read.parquet(path)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.align(docs).collect()), key=repr) == brute(rows, tokenizers)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_lanes_keep_tokens(tokenizers):
    a, b = tokenizers
    rng = random.Random(3)
    text = "".join(rng.choices(["w ", "a1 ", " b", "'s ", "é ", "\n", "longer word ", ", "], k=4000))
    parts = alignment.lanes(text, 20)
    assert len(parts) > 100 and " ".join(parts) == text
    assert [i for p in parts for i in a.encode(" " + p).ids] == a.encode(" " + text).ids
    assert [i for p in parts for i in b.encode(p)] == b.encode(text)
    side = alignment.ByteLevel(alignment.A_FILE)
    assert side.encode(text).tolist() == a.encode(" " + text).ids


def test_large_groups_by_distinct_ids(monkeypatch):
    groups = np.array([[0, 3], [3, 7], [0, 4], [4, 6]])
    a, b = np.array([1, 1, 2, 5, 5, 5, 6]), np.array([3, 3, 4, 3, 9, 9])

    def summed():
        out = Counter()
        for g, code, n in zip(*alignment.linked(groups, a, b)):
            out[int(g), int(code)] += int(n)
        return out

    every = summed()
    monkeypatch.setattr(alignment, "GROUP", 2)
    assert summed() == every and every.total() == 3 * 4 + 4 * 2


def test_blocks_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "bbb", "c" * 10, "", "d"]})
    assert [b.num_rows for b in blocks.cut([batch], size=5)] == [3, 1, 2]
    assert [b.num_rows for b in blocks.cut([batch.slice(0, 0)], size=5)] == []
