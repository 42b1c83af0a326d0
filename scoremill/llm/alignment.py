"""Alignment of two tokenizers: which tokens of A and B stand for the same bytes.

Byte offsets where tokens of both end are cuts; the tokens between two cuts form a group, and every token of A in a
group is linked with every one of B. Cuts are found in lockstep: a numpy state vector holds a pointer into A's and one
into B's tokens for every lane of a block of documents. In each step the pointer whose token ends first moves on, both
where they end together; there a group is closed and emitted, with its links as two ranges of tokens. Lanes that have
reached their end are compacted away.

A long text runs in several lanes. They begin at single blanks between ASCII letters or digits: there a token of A
ends, and B's vocabulary has no piece that goes on over a blank behind another character. Both tokenizers therefore
give the same tokens for the parts as for the whole, and memory does not grow with the text.

How many documents hold a pair of ids linked is counted over the corpus: blocks list their distinct pairs once, with
the number of their documents, and get the sums back (:mod:`scoremill.llm.blocks`).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoremill.llm import blocks
from scoremill.session import stage

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
LANE = 1000  # characters of a lane at least, where a text is longer
BORDER = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
UNBROKEN = re.compile(r"\S{2000}|\s{2000}")
COMPACT = 16  # steps between two compactions
GROUP = 1 << 16  # links of a group that are listed one by one; larger groups are counted by distinct ids
BITS = 20  # of an id of B within the code of a pair
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WRITTEN = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "at array<int>, times array<int>, code array<long>, holders array<int>"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_level() -> dict[str, int]:
    """Byte of every character by which byte-level vocabularies write it: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids and token bytes of a byte-level BPE file, special tokens' strings being ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte_of = byte_level()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        order = [model["model"]["vocab"][t] for t in merged]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of merges")
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        self._fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path = path

    @functools.cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self._path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, text: str) -> np.ndarray:
        """Ids of a blank and the text."""
        # the fast one needs quadratic time for a long string without a break; both give the same ids
        if UNBROKEN.search(text):
            return np.array(self._slow.encode(f" {text}", add_special_tokens=False).ids, np.int64)
        return self._fast.encode_to_numpy(f" {text}", disallowed_special=())


class Pieces:
    """Ids and token bytes of a SentencePiece model, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
            if re.search("[^▁]▁", piece):
                raise ValueError(f"piece {piece!r} goes over the border of a lane")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a blank and the text."""
        return np.array(self._model.encode(text), np.int64)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks of a text as they stand in it. A line break, which no piece goes over, keeps the others apart."""
        found = self._model.encode([f"{c[1:]}\n" if c[0] == " " else f"\n{c}" for c in chunks], num_threads=1)
        return [ids[:-1] if c[0] == " " else ids[2:] for c, ids in zip(chunks, found)]


def lanes(text: str, least: int = LANE) -> list[str]:
    """Parts of a text that are tokenized alike alone; the blank between two parts belongs to the next."""
    parts, low = [], 0
    while len(text) - low > 2 * least and (border := BORDER.search(text, low + least)):
        parts.append(text[low : border.start()])
        low = border.end()
    return [*parts, text[low:]]


@dataclass
class Tokens:
    """Tokens of one side of a block: ids, byte offset of every end, and where the tokens of each lane start."""

    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


def lockstep(a: Tokens, b: Tokens) -> np.ndarray:
    """Groups of all lanes: columns first and last A token (end exclusive), first and last B token, in text order.

    Both sides of every lane hold the same bytes, and offsets run on over the lanes. So a lane that is done may run on
    into the next, whose cuts it repeats, until it is compacted away.
    """
    at_a, at_b, stop = a.starts[:-1], b.starts[:-1], a.starts[1:]
    room = np.full(COMPACT, np.iinfo(np.int64).max)
    ends_a, ends_b = np.concatenate([a.ends, room]), np.concatenate([b.ends, room])
    cuts_a, cuts_b = np.zeros(len(ends_a) + 1, bool), np.zeros(len(ends_b) + 1, bool)
    while True:
        left = np.flatnonzero(at_a < stop)
        if not len(left):
            break
        at_a, at_b, stop = at_a[left], at_b[left], stop[left]
        for _ in range(COMPACT):
            end_a, end_b = ends_a[at_a], ends_b[at_b]
            move_a, move_b = end_a <= end_b, end_b <= end_a
            at_a += move_a
            at_b += move_b
            cut = move_a & move_b
            cuts_a[at_a[cut]] = True
            cuts_b[at_b[cut]] = True
    last_a, last_b = np.flatnonzero(cuts_a[: len(a.ends) + 1]), np.flatnonzero(cuts_b[: len(b.ends) + 1])
    first = lambda last: np.concatenate([np.zeros(1, np.int64), last])[:-1]
    return np.stack([first(last_a), last_a, first(last_b), last_b])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    first = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - first, lengths)


def linked(groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs linked in the groups: number of the group, code of the two ids, and how often."""
    n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
    small = np.flatnonzero(n_a * n_b <= GROUP)
    lead = spread(groups[0, small], n_a[small])
    each = np.repeat(n_b[small], n_a[small])
    owner = np.repeat(np.repeat(small, n_a[small]), each)
    code = np.repeat(a[lead], each) << BITS | b[spread(np.repeat(groups[2, small], n_a[small]), each)]
    found = [(owner, code, np.ones(len(code), np.int64))]
    for g in np.flatnonzero(n_a * n_b > GROUP):
        ids_a, times_a = np.unique(a[groups[0, g] : groups[1, g]], return_counts=True)
        ids_b, times_b = np.unique(b[groups[2, g] : groups[3, g]], return_counts=True)
        code = np.repeat(ids_a, len(ids_b)) << BITS | np.tile(ids_b, len(ids_a))
        found.append((np.full(len(code), g), code, np.outer(times_a, times_b).ravel()))
    owner, code, times = (np.concatenate(x) for x in zip(*found))
    return owner, code, times


class Aligner:
    """Aligns blocks of texts."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self.long = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        # every token's number with what may follow it; zero bytes behind are taken away when they are joined
        names = [f"{i}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side.bytes)) for mark in marks]
        self.names = np.array(names, "S8")
        flat = [np.frombuffer(b"".join(side.bytes), np.uint8) for side in (self.a, self.b)]
        self.flat = [(f, np.cumsum(long) - long) for f, long in zip(flat, self.long)]

    def tokens(self, texts: list[str | None]) -> tuple[Tokens, Tokens, np.ndarray]:
        """Tokens of both sides by lanes, and the document of each lane. Documents that differ have no lanes."""
        parts = [lanes(t) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        raw = [b" " + part.encode() for p in parts for part in p]
        lengths = np.array([len(r) for r in raw], np.int64)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        sides, same = [], np.ones(len(raw), bool)
        for side, long, (flat, first) in zip((self.a, self.b), self.long, self.flat):
            found = [side.encode(part) for p in parts for part in p]
            starts = np.cumsum([0, *map(len, found)])
            ids = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
            sizes = blocks.totals(long[ids], np.diff(starts))
            same &= sizes == lengths
            fits = np.flatnonzero(sizes == lengths)
            mine = np.repeat(sizes == lengths, np.diff(starts))
            spelt = flat[spread(first[ids[mine]], long[ids[mine]])]
            meant = whole if len(fits) == len(raw) else whole[np.repeat(sizes == lengths, lengths)]
            wrong = np.flatnonzero(spelt != meant)
            same[fits[np.searchsorted(np.cumsum(lengths[fits]), wrong, "right")]] = False
            sides.append((ids, starts))
        differ = np.unique(owner[~same])
        kept = ~np.isin(owner, differ)
        out = []
        for long, (ids, starts) in zip(self.long, sides):
            counts = np.diff(starts)
            ids = ids[np.repeat(kept, counts)]
            out.append(Tokens(ids, np.cumsum(long[ids]), np.cumsum(np.concatenate([np.zeros(1, np.int64), counts[kept]]))))
        return out[0], out[1], owner[kept]

    def written(self, groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of all groups in the order of the written form, each with the mark behind it."""
        n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
        at_a = np.arange(len(a)) + np.repeat(groups[2], n_a)
        at_b = np.arange(len(b)) + np.repeat(groups[1], n_b)
        number = np.zeros(len(a) + len(b), np.int64)
        number[at_a], number[at_b] = a * 2, (b + len(self.a.bytes)) * 2
        number[groups[1] - 1 + groups[2]] += 1
        number[groups[3] - 1 + groups[1]] += 1
        return self.names[number]

    def align(self, block: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        """Rows of the documents of a block, and one with its distinct pairs and the documents that hold each."""
        texts = block.column("text").to_pylist()
        a, b, owner = self.tokens(texts)
        groups = lockstep(a, b)
        n = len(texts)
        lane = np.searchsorted(a.starts, groups[0], "right") - 1
        of_group = owner[lane] if len(lane) else np.zeros(0, np.int64)
        n_a, n_b = groups[1] - groups[0], groups[3] - groups[2]
        count = lambda weights=None: np.bincount(of_group, weights, n).astype(np.int64)
        sums = {"n_a": count(n_a), "n_b": count(n_b), "n_groups": count(), "n_links": count(n_a * n_b)}
        names = self.written(groups, a.ids, b.ids)
        ends = np.cumsum(sums["n_a"] + sums["n_b"])
        digests = [
            hashlib.sha256(names[e - k : e].tobytes().translate(None, b"\0")[:-1]).hexdigest() if k else ""
            for e, k in zip(ends.tolist(), (sums["n_a"] + sums["n_b"]).tolist())
        ]
        group, code, times = linked(groups, a.ids, b.ids)
        pairs, place = np.unique(code, return_inverse=True)
        # per document: distinct pairs as places in the block's list, and how often each is linked
        key, first, back = np.unique(of_group[group] * max(1, len(pairs)) + place, return_index=True, return_inverse=True)
        often = np.bincount(back, times, len(key)).astype(np.int64)
        at = place[first]
        per_doc = np.bincount(of_group[group][first], minlength=n)
        rows = {"block": [number] * n, "doc_id": block.column("doc_id"), **sums, "groups_sha256": digests}
        rows["at"] = blocks.lists(at, np.cumsum(per_doc), pa.int32())
        rows["times"] = blocks.lists(often, np.cumsum(per_doc), pa.int32())
        listed = {
            "block": [number],
            "code": blocks.lists(pairs, np.array([len(pairs)]), pa.int64()),
            "holders": blocks.lists(np.bincount(at, minlength=len(pairs)), np.array([len(pairs)]), pa.int32()),
        }
        for columns, size in ((rows, n), (listed, 1)):
            yield pa.RecordBatch.from_arrays(
                [_as(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in SCHEMA], schema=SCHEMA
            )


@functools.lru_cache(1)
def aligner(a_file: str, b_file: str) -> Aligner:
    """One per worker, so that vocabularies are read once."""
    return Aligner(a_file, b_file)


SCHEMA = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string())]
    + [("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("code", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))]
)


def _as(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _result(documents: pa.Table, values: pa.Table) -> pa.Table:
    at = documents["at"].combine_chunks()
    lengths = at.value_lengths().to_numpy()
    flat = at.flatten().to_numpy()
    times = documents["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    holders, best = (values[c].to_numpy() for c in ("n", "best"))
    sums = {
        "n_best": blocks.totals(times * best[flat] if len(flat) else times, lengths),
        "count_sum": blocks.totals(times * holders[flat] if len(flat) else times, lengths),
    }
    columns = {c: documents[c] for c in ("doc_id", *COUNTS, "groups_sha256")} | {c: pa.array(v, pa.int64()) for c, v in sums.items()}
    return pa.table({c: columns[c] for c in ("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")})


def align_blocks(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Aligned documents by blocks, as written by :func:`align` for its two passes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in zip(blocks.numbers(), blocks.cut(batches)):
            yield from aligner(a_file, b_file).align(block, number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, WRITTEN)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): documents that hold each pair of ids linked; best is 1 if n is the highest of the A id."""
    counts = blocks.dictionary(aligned, "code", "holders").groupBy("code").agg(F.sum("holders").alias("n"))
    # a group of the window has a row per id of B at most
    highest = F.max("n").over(Window.partitionBy(F.shiftright("code", BITS)))
    return counts.withColumn("best", (F.col("n") == highest).cast("long"))


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per document (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A counts a blank and the text, B the text (it adds the blank). ``n_links`` counts pairs of token occurrences in a
    common group, ``n_best`` those whose pair of ids is held by as many documents as any pair of that A id (ties
    included), ``count_sum`` sums the number of documents over all links. ``groups_sha256`` is the digest of
    ``a1,a2|b1;a3|b2,b3``.

    A null or empty text, and one whose tokens do not spell a blank and the text, has zeros and an empty digest; it
    counts in no pair. Repeated rows, also of one id, are documents of their own. A very long text is cut into lanes
    and takes memory for its ids only; where it has no blank between ASCII letters or digits it is one lane. A null
    id stays null, extra columns are ignored, an empty table gives an empty result.
    """
    aligned = stage(align_blocks(docs, a_file, b_file))
    values = blocks.dictionary(aligned, "code").join(pair_counts(aligned), "code").select("block", "place", "n", "best")
    documents = aligned.where(F.col("code").isNull()).select("block", "doc_id", *COUNTS, "groups_sha256", "at", "times")
    return blocks.give_back(documents, values, _result, RESULT)
