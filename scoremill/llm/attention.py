"""Scoring texts by a causal self-attention model over subword ids, trained in numpy.

The probability of an id is that of its class given what came before, times its share of the class. Shares, and the
class to expect after one id, are counts over all training documents. A self-attention layer corrects the latter by the
context: the logits of the next class are the counts' logarithms after the last id, plus ``tanh(x + a) W``, where x is
the last id's embedding and a what it attends to. Before training W is zero, so the model starts as the counts are.

A text is scored in windows that overlap: STEP positions are scored with themselves and the STEP before them as
context, so each id is scored once, with STEP to 2 STEP - 1 ids before it. Windows go through masked attention in
batches, whatever texts they come from; a long text takes no more memory for it than a short one.

The layer is trained in rounds, which deal all training documents among them. In a round, trainers learn from the same
parameters on documents of their own, batch by batch where these lie; the parameters' means start the next one. They are
as large as the vocabulary and are added up in a tree.

Windows lie in blocks of STEP positions: the context of a window is the block before it, so what is worked out for a
position serves both. Texts are tokenized chunk by chunk (blanks with the word behind them): no piece goes over the
border of one, and a block of documents, which is read in parts, tokenizes each of its chunks once.

The base score needs a count for every word: blocks of documents list their words once and get the counts back
(:mod:`scoremill.llm.blocks`), but for words that are theirs alone.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain, count as counter, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from scoremill.llm import blocks
from scoremill.llm.alignment import Pieces, lanes
from scoremill.llm.pieces import CHUNKS, MARK
from scoremill.session import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
START, END = 1, 2  # ids of the vocabulary's marks
WIDTH = 16
STEP = 16
SINGLE, SHARED = 48, 16  # classes of one id each, and of several
LEAST = 0.05  # added to the count of every id
PRIOR = 4.0  # weight of the classes' overall shares against counts after an id
BATCH = 128  # windows at a time
SLOTS = 64  # equal shares of the training documents by a hash; rounds learn from them in turn
ROUNDS = 4
RATE = 0.1
CALM = 1e-5  # squared gradients that every weight starts with
TRAINER = 8_000_000  # ids a trainer learns from in a round, about
FAN = 16  # sets of parameters added up at a time
BLOCK, KINDS = 32 << 20, 400_000  # bytes of text, and different chunks, whose words are listed together, about
READ = 4 << 20  # bytes of text read at a time; a longer text is one by itself
ENCODED = 1 << 14  # chunks tokenized at a time
PART = 1 << 20  # ids of texts in work at a time; a longer text is one by itself
LONG_WORD = 64  # characters; longer words are known by their digest
NEVER = -1e9
HIGH = 60.0

WRITTEN = (
    "block long, row int, doc_id long, held_out boolean, slot int, n_tokens long, ids binary, "
    "word array<string>, n array<long>, piece array<int>, seen array<long>, held binary"
)
PARAMETERS = "node long, weight double, raw binary"
SCORED = "block long, row int, doc_id long, held_out boolean, n_tokens long, score double"
BASE = "block long, row int, n_known long, base_score double"
SCHEMA = pa.schema(
    [("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("slot", pa.int32()), ("n_tokens", pa.int64())]
    + [("ids", pa.binary()), ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]
    + [("piece", pa.list_(pa.int32())), ("seen", pa.list_(pa.int64())), ("held", pa.binary())]
)


# ---- the model -----------------------------------------------------------------------------------


@dataclass
class Layer:
    """What is trained: embeddings (one more for padding), projections, a bias by distance, and the output."""

    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    distance: np.ndarray
    out: np.ndarray

    @staticmethod
    def start(vocabulary: int, classes: int, width: int = WIDTH) -> Layer:
        rng = np.random.default_rng(1)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        embed = draw(vocabulary + 1, width, scale=0.5)
        embed[-1] = 0
        square = [draw(width, width, scale=width**-0.5) for _ in range(3)]
        return Layer(embed, *square, np.zeros(2 * STEP, np.float32), np.zeros((width, classes), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.arrays())

    def like(self, raw: bytes) -> Layer:
        flat, at, out = np.frombuffer(raw, np.float32), 0, []
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        return Layer(*out)


@dataclass(frozen=True)
class Counts:
    """Statistics of all training documents: the class of every id, log share within it, and log of classes after an id."""

    class_of: np.ndarray
    share: np.ndarray
    after: np.ndarray


def classes(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id, and the logarithm of its share in the class. The most frequent ids have one of their own."""
    mass = seen + LEAST
    order = np.lexsort((np.arange(len(mass)), -mass))
    class_of = np.empty(len(mass), np.int64)
    class_of[order[:SINGLE]] = np.arange(min(SINGLE, len(mass)))
    rest = order[SINGLE:]
    if len(rest):
        below = np.cumsum(mass[rest]) - mass[rest]
        class_of[rest] = SINGLE + np.minimum(SHARED - 1, (below / mass[rest].sum() * SHARED).astype(np.int64))
    return class_of, np.log(mass / np.bincount(class_of, mass, SINGLE + SHARED)[class_of])


def after(pairs: np.ndarray, class_of: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Log probability of the next class by id, from counts by id (rows) and class."""
    overall = np.bincount(class_of, seen + LEAST, pairs.shape[1])
    overall /= overall.sum()
    overall = np.maximum(overall, 1e-12)
    return np.log((pairs + PRIOR * overall) / (pairs.sum(1, keepdims=True) + PRIOR)).astype(np.float32)


@dataclass(frozen=True)
class Windows:
    """Of windows one after the other: inputs in blocks of STEP (padding: the number of ids), targets (none: -1), and texts.

    The first block is the context of the first window, the others are what each window scores. ``first`` says which
    windows begin a text.
    """

    inputs: np.ndarray
    first: np.ndarray
    targets: np.ndarray
    owner: np.ndarray


def windows(ids: np.ndarray, lengths: np.ndarray, padding: int, size: int = BATCH) -> Iterator[Windows]:
    """Windows over texts, whose ids end with END, ``size`` at a time. A text without ids has none."""
    number = -(-lengths // STEP)
    owner = np.repeat(np.arange(len(lengths)), number)
    begin = (np.cumsum(number) - number)[lengths > 0]
    first = np.zeros(len(owner), bool)
    first[begin] = True
    # texts lie STEP by STEP, each from a block of its own; input 0 is START, input p the id at p - 1, its target the id at p
    place = np.repeat((np.cumsum(number) - number) * STEP - np.cumsum(lengths) + lengths, lengths)
    place += np.arange(len(ids))
    targets = np.full(len(owner) * STEP, -1, np.int64)
    targets[place] = ids
    inputs = np.full((len(owner) + 1) * STEP, padding, np.int64)
    inputs[place[1:] + STEP] = ids[:-1]
    targets, inputs = targets.reshape(-1, STEP), inputs.reshape(-1, STEP)
    inputs[begin + 1, 0] = START
    for low in range(0, len(owner), size):
        mine = inputs[low : low + size + 1]
        if first[low]:
            mine = np.concatenate([np.full((1, STEP), padding), mine[1:]])
        yield Windows(mine, first[low : low + size], targets[low : low + size], owner[low : low + size])


CAUSAL = np.where(np.arange(2 * STEP) > np.arange(STEP)[:, None] + STEP, np.float32(NEVER), np.float32(0))
DISTANCE = np.clip(np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP), 0, 2 * STEP - 1)


def with_context(x: np.ndarray) -> np.ndarray:
    """Every block but the first behind the block before it, as a view. For the first window of a text that is another text's."""
    return np.ndarray((len(x) - 1, 2 * STEP, x.shape[2]), x.dtype, x, 0, x.strides)


def attend(q: np.ndarray, k: np.ndarray, bias: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights for every scored position, and what to divide them by; ``first`` windows of a text have no context."""
    w = q @ k.transpose(0, 2, 1)
    w += bias
    w[first, :, :STEP] = NEVER
    # every position sees itself; where that and the largest are moderate, exp neither overflows nor leaves zeros alone
    if not (w.max() < HIGH and w[:, np.arange(STEP), np.arange(STEP, 2 * STEP)].min() > -HIGH):
        w -= w.max(2, keepdims=True)
    np.exp(w, out=w)
    return w, (w.reshape(-1, 2 * STEP) @ np.ones(2 * STEP, w.dtype)).reshape(len(w), STEP, 1)


def moderate(out: np.ndarray) -> bool:
    """Whether the layer moves logits so little that exp of float32 holds twice that."""
    return float(np.abs(out).sum(0).max()) < 40


class Scorer:
    """Log probabilities of texts under a trained layer; the projections of every id are worked out once."""

    def __init__(self, layer: Layer, counts: Counts):
        self.layer, self.counts = layer, counts
        scale = np.float32(layer.embed.shape[1] ** -0.5)
        own = [layer.embed @ (layer.query * scale), layer.embed, layer.embed @ layer.key, layer.embed @ layer.value]
        self.known = np.concatenate(own, 1)
        self.bias = CAUSAL + layer.distance[DISTANCE]
        self.bounded = moderate(layer.out)

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of every text; the ids of one that has any end with END."""
        total = np.zeros(len(lengths))
        c, width = self.counts, self.layer.embed.shape[1]
        for w in windows(ids, lengths, len(c.class_of)):
            known = self.known.take(w.inputs, 0, mode="clip")
            around = with_context(known)
            weight, whole = attend(known[1:, :, :width], around[:, :, 2 * width : 3 * width], self.bias, w.first)
            a = weight @ around[:, :, 3 * width :]
            a /= whole
            a += known[1:, :, width : 2 * width]
            logits = np.tanh(a, out=a).reshape(-1, width) @ self.layer.out
            # positions behind the end of a text have no target and may look up anything
            logits += c.after.take(w.inputs[1:].ravel(), 0, mode="clip")
            if not self.bounded:
                logits -= logits.max(1, keepdims=True)
            target = w.targets.ravel()
            real = target >= 0
            chosen = logits.ravel().take(np.arange(len(target)) * logits.shape[1] + c.class_of.take(target, mode="clip"))
            chosen -= np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))
            chosen = np.where(real, chosen + c.share.take(target, mode="clip"), 0)
            total += np.bincount(w.owner, chosen.reshape(-1, STEP).sum(1), len(lengths))
        return total / math.log(10)


def gradients(layer: Layer, counts: Counts, w: Windows) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Mean loss over the scored ids of a batch, the ids in it, and the gradient of the arrays; of embeddings, for those ids."""
    width, ids = layer.embed.shape[1], w.inputs
    x = layer.embed.take(ids, 0)
    flat_x, here = x.reshape(-1, width), x[1:]
    query = layer.query * np.float32(width**-0.5)
    key_value = np.concatenate([layer.key, layer.value], 1)
    q, known = here @ query, (flat_x @ key_value).reshape(*ids.shape, 2 * width)
    around = with_context(known)
    k, v = around[:, :, :width], around[:, :, width:]
    weight, whole = attend(q, k, CAUSAL + layer.distance[DISTANCE], w.first)
    weight /= whole
    a = weight @ v
    h = (here + a).reshape(-1, width)
    np.tanh(h, out=h)
    logits = h @ layer.out
    # positions behind the end of a text have no target and may look up anything
    logits += counts.after.take(ids[1:].ravel(), 0, mode="clip")
    if not moderate(layer.out):
        logits -= logits.max(1, keepdims=True)
    g = np.exp(logits, out=logits)
    whole = g @ np.ones(g.shape[1], g.dtype)
    target = w.targets.ravel()
    real = np.flatnonzero(target >= 0)
    n, cell, of_real = max(1, len(real)), (real, counts.class_of[target[real]]), whole[real]
    chosen = g[cell]
    loss = -float(np.log(chosen / of_real).sum()) / n
    share = np.zeros_like(whole)
    share[real] = 1 / (of_real * n)
    # the gradient of the logits is this times the share, which goes to the narrower factors
    g[cell] = chosen - of_real
    share = share[:, None]
    g_out = (h * share).T @ g
    h *= h
    np.subtract(1, h, out=h)
    h *= share
    h *= g @ layer.out.T
    g_sum = h.reshape(a.shape)
    g_s = g_sum @ v.transpose(0, 2, 1)
    g_s -= np.einsum("bsw,bsw->bs", g_sum, a)[:, :, None]
    g_s *= weight
    g_distance = np.bincount(DISTANCE.ravel(), g_s.sum(0).ravel(), 2 * STEP).astype(np.float32)
    g_q = (g_s @ k).reshape(-1, width)
    both = np.empty(around.shape, known.dtype)
    np.matmul(g_s.transpose(0, 2, 1), q, out=both[:, :, :width])
    np.matmul(weight.transpose(0, 2, 1), g_sum, out=both[:, :, width:])
    g_known = np.empty_like(known)
    g_known[1:] = both[:, STEP:]
    g_known[0] = 0
    g_known[:-1] += both[:, :STEP]
    g_known = g_known.reshape(-1, 2 * width)
    g_x = g_known @ key_value.T
    rest = g_q @ query.T
    rest += h
    g_x[STEP:] += rest
    flat = ids.ravel()
    order = np.argsort(flat.astype(np.min_scalar_type(len(counts.class_of))), kind="stable")
    flat = flat[order]
    begin = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(flat[1:] != flat[:-1]) + 1])
    rows, g_embed = flat[begin], np.add.reduceat(g_x[order], begin, 0)
    g_embed[rows == len(counts.class_of)] = 0
    g_key_value = flat_x.T @ g_known
    g_query = (flat_x[STEP:].T @ g_q) * np.float32(width**-0.5)
    return loss, rows, [g_embed, g_query, g_key_value[:, :width], g_key_value[:, width:], g_distance, g_out]


class Training:
    """A layer on its way by Adagrad, which learns from texts as they come."""

    def __init__(self, layer: Layer, counts: Counts, rate: float = RATE):
        self.layer, self.counts, self.rate = layer, counts, rate
        self.power = [np.full_like(x, CALM) for x in layer.arrays()]

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> list[float]:
        """Losses of the batches of windows."""
        losses = []
        for w in windows(ids, lengths, len(self.counts.class_of)):
            loss, rows, grads = gradients(self.layer, self.counts, w)
            losses.append(loss)
            for x, p, g, at in zip(self.layer.arrays(), self.power, grads, (rows, *[slice(None)] * 5)):
                power = p[at] + g * g
                p[at] = power
                x[at] -= self.rate * g / np.sqrt(power)
        return losses


def train(layer: Layer, counts: Counts, ids: np.ndarray, lengths: np.ndarray, rate: float = RATE) -> tuple[Layer, float]:
    """The layer after one pass over the texts by Adagrad, and the mean loss on the way."""
    losses = Training(layer, counts, rate).learn(ids, lengths)
    return layer, float(np.mean(losses)) if losses else 0.0


# ---- over the corpus -----------------------------------------------------------------------------


@functools.lru_cache(1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _numbers(first: str | bytes) -> defaultdict:
    """Numbers of the keys it is asked for, in that order; the first has 0."""
    numbers = defaultdict(counter().__next__)
    numbers[first]
    return numbers


def chunks(text: str) -> list[str]:
    """Parts that are tokenized alike alone, the first behind a blank; the vocabulary's mark is taken for a blank, too."""
    return [f" {p}" for p in lanes(text)] if MARK in text else CHUNKS.findall(f" {text}") if text else []


class _Lists:
    """Lists of numbers, known by their own, of which more come; the first holds one number."""

    def __init__(self, first: int, kind: type):
        self.values, self.sizes = np.array([first], kind), np.ones(1, np.int64)

    def add(self, more: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.values, self.sizes = (np.concatenate(x) for x in zip((self.values, self.sizes), *more))

    def unfold(self, which: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the lists named in ``which``, and how many come from each of its runs of ``lengths``."""
        mine = self.sizes[which]
        ends = np.cumsum(mine)
        # where a list starts, less where it comes to lie
        shift = (np.cumsum(self.sizes) - self.sizes)[which] - (ends - mine)
        at = np.repeat(shift.astype(np.int32), mine)
        at += np.arange(len(at), dtype=np.int32)
        return self.values[at], blocks.totals(mine, lengths)


def _listed(lists: list[list[int]], kind: type) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), kind, sizes.sum()), sizes


BLANK = " \t\n\r\x0b\x0c"


def _words(parts: list[str], numbers: defaultdict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all chunks, and how many each has."""
    words = " ".join(parts).encode().split()
    # a chunk whose last character is no blank has a word; if there are no more words than such chunks, all have that one
    sizes = np.fromiter((p[-1] not in BLANK for p in parts), np.int64, len(parts))
    if len(words) != sizes.sum():
        sizes = np.fromiter((len(p.encode().split()) for p in parts), np.int64, len(parts))
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), sizes


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in SCHEMA], schema=SCHEMA)


def distinct_chunks(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different chunks of texts in lower case, the places of all texts' chunks among them, and how many each text has."""
    raw = b"".join([b" " + t for t in texts if t]).translate(LOWER)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if MARK.encode() in raw:
        held = [chunks(t.translate(LOWER).decode()) for t in texts]
        lengths = np.array([len(c) for c in held], np.int64)
        listed = pa.array([c for doc in held for c in doc], pa.string())
    else:
        # as CHUNKS divides them: at line breaks and at the first blank of several
        data = np.frombuffer(raw, np.uint8)
        blank, line = data == 32, data == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        ends = np.cumsum(size)
        begins[(ends - size)[size > 0]] = True
        begins = np.flatnonzero(begins)
        lengths = np.diff(np.searchsorted(begins, ends), prepend=0)
        offsets = np.append(begins, len(raw)).astype(np.int32)
        listed = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    coded = listed.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lengths


class Block:
    """Documents that share lists of their chunks and words. They are read in parts, each of its chunks once for all."""

    def __init__(self, number: int, path: str):
        self.number, self.pieces = number, _pieces(path)
        self.kinds, self.numbers = _numbers(""), _numbers(b"")  # chunks and words; the first is the end
        self.ids, self.words = _Lists(END, np.int16), _Lists(0, np.int32)
        self.trained, self.seen = np.zeros(1, np.int64), np.zeros(len(self.pieces.bytes), np.int64)
        self.rows = self.bytes = 0

    def full(self) -> bool:
        return len(self.kinds) >= KINDS or self.bytes >= BLOCK

    def read(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of the documents of a part, and one with the places of their words."""
        found, which, lengths = distinct_chunks([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
        found = np.fromiter(map(self.kinds.__getitem__, found), np.int32, len(found))
        # behind the chunks of each document is its end
        n, held = len(lengths), np.zeros(len(which) + len(lengths), np.int32)
        held[np.arange(len(which)) + np.repeat(np.arange(n), lengths)] = found[which]
        lengths += 1
        new = list(islice(self.kinds, len(self.ids.sizes), None))
        some = [new[low : low + ENCODED] for low in range(0, len(new), ENCODED)]
        self.ids.add([_listed(self.pieces.encode_chunks(c), np.int16) for c in some])
        self.words.add([_words(c, self.numbers) for c in some])
        flat_ids, sizes = self.ids.unfold(held, lengths)
        flat, long = self.words.unfold(held, lengths)
        owner = np.repeat(np.arange(n), long)
        key, times = np.unique(owner * len(self.numbers) + flat, return_counts=True)
        doc, at = np.divmod(key, len(self.numbers))
        learned = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False))
        trained = np.bincount(at, times * learned[doc], len(self.numbers)).astype(np.int64)
        trained[: len(self.trained)] += self.trained
        self.trained = trained
        self.seen += np.bincount(flat_ids[np.repeat(learned, sizes)], minlength=len(self.seen))
        steps = np.where(np.diff(doc, prepend=-1) > 0, at, np.diff(at, prepend=0))
        yield _rows(
            n,
            block=pa.array([self.number] * n),
            row=pa.array(np.arange(self.rows, self.rows + n), pa.int32()),
            **{c: part.column(c) for c in ("doc_id", "held_out", "slot")},
            n_tokens=pa.array(long),
            ids=_packed(flat_ids, sizes),
        )
        shut = _shut(np.bincount(doc, minlength=n), steps, times)
        yield _rows(1, block=pa.array([self.number]), row=pa.array([self.rows], pa.int32()), held=pa.array([shut], pa.binary()))
        self.rows += n
        self.bytes += part.column("text").nbytes

    def lists(self) -> pa.RecordBatch:
        """The row with all words and ids and how often training documents hold them."""
        listed = [w if len(w) <= LONG_WORD else b" " + hashlib.sha256(w).hexdigest().encode() for w in self.numbers]
        held = np.flatnonzero(self.seen)
        return _rows(
            1,
            block=pa.array([self.number]),
            word=pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), pa.array(listed, pa.binary()).cast(pa.string())),
            n=blocks.lists(self.trained, np.array([len(self.trained)]), pa.int64()),
            piece=blocks.lists(held, np.array([len(held)]), pa.int32()),
            seen=blocks.lists(self.seen[held], np.array([len(held)]), pa.int64()),
            held=pa.array([_shut(self.trained)], pa.binary()),
        )


def read(parts: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks of a task."""
    block = None
    for number in blocks.numbers():
        for part in parts:
            block = block or Block(number, path)
            yield from block.read(part)
            if block.full():
                break
        if block is None:
            return
        yield block.lists()
        block = None


def read_blocks(docs: DataFrame, path: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    slot = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SLOTS)).cast("int")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = chosen.select("doc_id", "text", held_out.alias("held_out"), slot.alias("slot"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a block's many lists form no cycles, and looking for some takes an eighth of the time
        try:
            yield from read(blocks.cut(batches, size=READ), path)
        finally:
            gc.enable()

    return chosen.mapInArrow(work, WRITTEN)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column, Arrow array or chunked."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def _packed(ids: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """Texts' ids as bytes: the JVM passes them on as they are, while it takes up every value of a list."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])


def _shut(*arrays: np.ndarray) -> bytes:
    """Arrays of int32 or int64 values as compressed bytes: how many each has, and the values."""
    raw = b"".join(x.astype(np.int64 if x.max(initial=0) >> 31 else np.int32).tobytes() for x in arrays)
    kinds = [(len(x), 8 if x.max(initial=0) >> 31 else 4) for x in arrays]
    return np.array(kinds, np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _opened(raw: bytes, number: int) -> list[np.ndarray]:
    """What :func:`_shut` was given."""
    kinds = np.frombuffer(raw, np.int64, 2 * number).reshape(number, 2)
    flat, at, out = pa.decompress(raw[16 * number :], int(kinds.prod(1).sum()), "zstd"), 0, []
    for n, size in kinds.tolist():
        out.append(np.frombuffer(flat, f"i{size}", n, at).astype(np.int64))
        at += n * size
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of texts, packed or in lists."""
    if not pa.types.is_binary(column.type):
        return _lists(column)
    if not len(column):
        return np.zeros(0, np.int16), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) >> 1
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.int16, ends[-1] - ends[0], 2 * ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.int16), np.diff(ends).astype(np.int64)


def parts(ids: np.ndarray, lengths: np.ndarray, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts one after the other, with at most so many ids or one text at a time. What is worked out for an id is many times its size."""
    ends, low = np.cumsum(lengths), 0
    while low < len(lengths):
        begin = ends[low] - lengths[low]
        high = max(low + 1, int(np.searchsorted(ends, begin + most, "right")))
        yield ids[begin : ends[high - 1]], lengths[low:high]
        low = high


def _pairing(class_of: np.ndarray):
    """Counts of (id before, class), of a task's texts."""
    n = SINGLE + SHARED

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(class_of) * n, np.int64)
        for batch in batches:
            for ids, lengths in parts(*_ids(batch.column("ids"))):
                before = np.empty(len(ids), np.int64)
                before[1:] = ids[:-1]
                before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
                before *= n
                before += class_of[ids]
                total += np.bincount(before, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": total[cells]})

    return pairs


def count(read: DataFrame, vocabulary: int) -> Counts:
    """Counts over all training documents. What reaches the driver is bounded by ids and ids times classes."""
    seen = np.zeros(vocabulary)
    for r in blocks.dictionary(read, "piece", "seen").groupBy("piece").agg(F.sum("seen").alias("n")).collect():
        seen[r["piece"]] = r["n"]
    class_of, share = classes(seen)
    n = SINGLE + SHARED
    learned = read.where("NOT held_out").select("ids").mapInArrow(_pairing(class_of), "cell long, n long")
    table = learned.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(vocabulary * n)
    cells[table["cell"].to_numpy()] = table["n"].to_numpy()
    return Counts(class_of, share, after(cells.reshape(vocabulary, n), class_of, seen))


def _mean(level: DataFrame) -> DataFrame:
    """Weighted sums of FAN sets of parameters each; the weights are added up too."""

    def add(rows: pa.Table) -> pa.Table:
        weight, total = 0.0, None
        for w, raw in zip(rows["weight"].to_pylist(), rows["raw"]):
            part = np.frombuffer(raw.as_buffer(), np.float32) * np.float32(w)
            total = part if total is None else total + part
            weight += w
        return pa.table({"node": [rows["node"][0].as_py()], "weight": [weight], "raw": [(total / np.float32(weight)).tobytes()]})

    return level.withColumn("node", F.expr(f"node div {FAN}")).groupBy("node").applyInArrow(add, PARAMETERS)


def _trainer(layer: Layer, counts: Counts):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, weight = Training(layer.like(layer.to_bytes()), counts), 0.0
        for batch in batches:
            for ids, lengths in parts(*_ids(batch.column("ids"))):
                mine.learn(ids, lengths)
                weight += len(ids)
        if weight:
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"node": [node], "weight": [weight], "raw": [mine.layer.to_bytes()]})

    return learn


def fit(read: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Layer:
    """The layer after rounds of distributed training, which together learn from every training document once."""
    layer = Layer.start(len(counts.class_of), counts.after.shape[1])
    learned = read.where("NOT held_out")
    size = F.size("ids") if isinstance(read.schema["ids"].dataType, ArrayType) else F.length("ids") / 2
    total = int(learned.agg(F.sum(size)).first()[0] or 0)
    for number in range(rounds if total else 0):
        mine = learned.where(F.col("slot") % rounds == number).select("ids")
        trainers = -(-total // (rounds * TRAINER))
        level = mine.coalesce(trainers).mapInArrow(_trainer(layer, counts), PARAMETERS)
        while trainers > 1:
            level, trainers = _mean(level), -(-trainers // FAN)
        if found := level.first():
            layer = layer.like(bytes(found["raw"]))
    return layer


def score(docs: DataFrame, path: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of the id as text modulo 5 is not 1, a null id among them. Counts cover them all,
    and so does the layer's training, in ``rounds`` (0: none). ``score`` is the log10 probability of the subword ids
    of the lower-cased text and an end; ``base_score`` that of its words and an end by their counts alone. A null or
    empty text is an end alone. Repeated rows are documents of their own and count as often; ties decide nothing, as
    equal ids have equal places. A very long text is scored window by window, in memory for its ids. Extra columns
    are ignored; an empty table gives an empty result.
    """
    read = stage(read_blocks(docs, path))
    counts = count(read, len(_pieces(path).bytes))
    layer = fit(read, counts, rounds)
    documents = read.where(F.col("ids").isNotNull())
    # dealt by word once: for the sums, and for the blocks that get them; a word counts as a kind where its first block is
    same, told = Window.partitionBy("word"), Observation()
    listed = blocks.dictionary(read, "word", "n").withColumns({"c": F.sum("n").over(same), "first": F.min("block").over(same)})
    listed = listed.observe(told, F.sum(F.expr("int(block = first AND c > 0)")).alias("kinds"))
    # a block knows the count of a word that no other block adds to
    values = stage(listed.where("c != n").select("block", "place", "c"))
    total = documents.where("NOT held_out").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    kinds = told.get.get("kinds") or 0

    def base(rows: pa.Table, known: pa.Table) -> pa.Table:
        block, out = rows["block"][0].as_py(), []
        held = dict(zip(rows["row"].to_pylist(), rows["held"]))
        (c,) = _opened(held.pop(None).as_py(), 1)
        c[known["place"].to_numpy()] = known["c"].to_numpy()
        logs = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        for first, raw in held.items():
            lengths, steps, times = _opened(raw.as_py(), 3)
            at = _places(steps, lengths)
            # sums per document, as a running sum over a block would lose digits
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), times * logs[at], len(lengths))
            row = pa.array(np.arange(first, first + len(lengths)), pa.int32())
            n_known = pa.array(blocks.totals(times * (c > 0)[at], lengths))
            out.append(pa.table([pa.array([block] * len(row)), row, n_known, pa.array(sums, pa.float64())], ["block", "row", "n_known", "base_score"]))
        return pa.concat_tables(out)

    kept = ["block", "row", "doc_id", "held_out", "n_tokens"]
    scores = documents.select(*kept, "ids").mapInArrow(_scoring(layer, counts), SCORED)
    based = blocks.give_back(read.where(F.col("held").isNotNull()).select("block", "row", "held"), values, base, BASE)
    return scores.join(based, ["block", "row"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _places(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places in a block's list from each document's first place and the steps to the next ones."""
    at = np.cumsum(steps, dtype=np.int64)
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    return at - np.repeat(at[first] - steps[first], lengths[lengths > 0])


def _scoring(layer: Layer, counts: Counts):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(layer, counts)
        for batch in batches:
            scores = [scorer.score(*part) for part in parts(*_ids(batch.column("ids")))]
            scores = pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "score"])

    return work
