"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a vocabulary span a lattice over a text. The forward pass gives the least cost of reaching every
position; it is the exact rest cost for a search from the end of the text backwards, so the A-star search completes
segmentations in order of their cost and never expands one that is not needed.

No piece goes on after a blank that follows another character, nor over a line break: the lattice falls into
independent chunks (blanks with the word behind them). A text's best segmentation joins the best ones of its chunks,
and its N best differ from it in chunks whose second best costs least more. So the forward pass keeps the best two
costs, and only the N - 1 cheapest chunks to change are searched. Chunks repeat; a bounded cache keeps their result.

Costs are whole millionths. A vocabulary of merges carries ranks, no probabilities; a piece of rank r has a share
of 1 / (r + 2), the law by which frequencies fall with the rank, in the sum of these over all pieces, and costs minus
the logarithm of its share. Characters without a piece are spelt in byte pieces at a cost beyond
that of any piece.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.llm.arrays import small_batches
from scoremill.llm.words import text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
CACHED = 500_000  # chunks a worker remembers before it starts anew, some 110 MB; changes no result
CHUNK = 1 << 20  # characters of text worked on at a time
LOCKSTEP = 32  # characters of chunks whose forward pass is shared; longer ones go alone; changes no result
TOGETHER = 1 << 15  # chunks in a shared forward pass
UNIT = 1_000_000
PENALTY = 10 * UNIT
NEVER = 1 << 60
CHUNKS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
MARK = "▁"  # a blank in the vocabulary file
ENCODED = (
    "struct<ids:array<int>,score:double,"
    "others:array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>"
)


@dataclass(frozen=True)
class PieceTree:
    """Tree of the beginnings of all pieces as sorted arrays; node 0 is the root, the last one stands for "none"."""

    alphabet: np.ndarray  # code points of the pieces
    edges: np.ndarray  # node * number of letters + letter
    nodes: np.ndarray  # where each edge leads
    piece: np.ndarray  # id of a node's piece, or -1
    cost: np.ndarray

    @staticmethod
    def of(pieces: dict[str, tuple[int, int]], starts) -> PieceTree:
        number = {"": 0} | {s: i for i, s in enumerate(starts, 1)}
        alphabet = np.array(sorted({ord(s[-1]) for s in starts}), np.uint32)
        letter = {chr(c): i for i, c in enumerate(alphabet.tolist())}
        edges = np.array([number[s[:-1]] * (len(letter) + 1) + letter[s[-1]] for s in starts], np.int64)
        order = np.argsort(edges)
        piece, cost = np.full(len(number) + 1, -1, np.int64), np.zeros(len(number) + 1, np.int64)
        for p, (i, c) in pieces.items():
            piece[number[p]], cost[number[p]] = i, c
        return PieceTree(alphabet, edges[order], np.arange(1, len(number))[order], piece, cost)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Places in the alphabet; one beyond it for other characters."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Node behind an edge, or -1."""
        key = node * (len(self.alphabet) + 1) + letter
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.nodes[at], -1)


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, tuple[int, int]]  # text -> id, cost
    costs: dict[str, int]  # of every piece, and -1 for the beginnings of pieces that are none themselves
    byte_ids: tuple[int, ...]
    spelt: int  # cost of a character in byte pieces
    longest: int
    text: tuple[bytes, ...]  # of every id
    tree: PieceTree


def load(path: str = MODEL) -> Vocabulary:
    """Vocabulary of a SentencePiece model with byte pieces; read on the driver and sent to the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, text = {}, {}, []
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            plain = piece.replace(MARK, " ")
            if "\n" in plain or re.search("[^ ] ", plain):
                raise ValueError(f"piece {piece!r} goes over the border of a chunk")
            text.append(plain.encode())
            pieces[plain] = (i, score)
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    spelt = tuple(byte_ids[b] for b in range(256))
    # pieces of blanks alone have no rank: a single blank ranks last, a run costs as much as the most frequent piece
    last = min(s for p, (_, s) in pieces.items() if p.strip(" "))
    ranks = {p: s if p.strip(" ") else last if p == " " else 0 for p, (_, s) in pieces.items()}
    whole = sum(1 / (2 - r) for r in ranks.values())
    pieces = {p: (i, round(UNIT * math.log((2 - ranks[p]) * whole))) for p, (i, _) in pieces.items()}
    top = max(c for _, c in pieces.values()) + PENALTY
    starts = {p[:n]: top if n == 1 else -1 for p in pieces for n in range(1, len(p))}
    costs = starts | {p: c for p, (_, c) in pieces.items()}
    return Vocabulary(pieces, costs, spelt, top, max(map(len, pieces)), tuple(text), PieceTree.of(pieces, costs))


def forward(chunk: str, v: Vocabulary) -> tuple[array, array, array]:
    """Least and second least cost of reaching every position, and where the last piece of the best way starts.

    Of equal costs the longer last piece counts. Positions without a (second) way have a cost of NEVER or more.
    """
    n, get, longest, spelt = len(chunk), v.costs.get, v.longest, v.spelt
    best, second, back = array("q", [NEVER]) * (n + 1), array("q", [NEVER]) * (n + 1), array("q", [0]) * (n + 1)
    best[0] = 0
    for start in range(n):
        here, next_here, last = best[start], second[start], start + longest
        for end in range(start + 1, (last if last < n else n) + 1):
            cost = get(chunk[start:end])
            if cost is None:
                if end > start + 1:
                    break
                cost = spelt
            elif cost < 0:
                continue
            total = here + cost
            if total < best[end]:
                other = next_here + cost
                second[end] = best[end] if best[end] < other else other
                best[end] = total
                back[end] = start
            elif total < second[end]:
                second[end] = total
    return best, second, back


def _ids(chunk: str, cuts: list[int], v: Vocabulary) -> list[int]:
    out = []
    for a, b in zip(cuts, cuts[1:]):
        found = v.pieces.get(chunk[a:b])
        if found is None:
            out += [v.byte_ids[x] for x in chunk[a:b].encode("utf-8", "surrogatepass")]
        else:
            out.append(found[0])
    return out


def best_of(chunk: str, v: Vocabulary) -> tuple[list[int], int, int | None]:
    """Ids and cost of the best segmentation, and how much more the second best costs (None: there is none)."""
    n = len(chunk)
    best, second, back = forward(chunk, v)
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return _ids(chunk, cuts[::-1], v), best[n], second[n] - best[n] if second[n] < NEVER else None


def best_of_many(chunks: list[str], v: Vocabulary) -> list[tuple[list[int], int, int | None]]:
    """``best_of`` of every chunk; those of up to ``LOCKSTEP`` characters go through the forward pass together.

    The chunks lie longest first, so that those which reach a position are the first ones of each array. From every
    start the tree of pieces is walked for all of them at once, and each piece met relaxes the position behind it.
    """
    out: list = [None] * len(chunks)
    order = sorted((i for i, c in enumerate(chunks) if len(c) <= LOCKSTEP), key=lambda i: -len(chunks[i]))
    for low in range(0, len(order), TOGETHER):
        some = order[low : low + TOGETHER]
        texts = [chunks[i] for i in some]
        lengths = np.array([len(t) for t in texts])
        width, m, tree = int(lengths[0]), len(some), v.tree
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((width, m), np.int64)
        row = np.repeat(np.arange(m), lengths)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = tree.letters(flat)
        reach = [int(np.searchsorted(-lengths, -p, "left")) for p in range(width + 2)]  # chunks longer than p
        best, second = np.full((width + 1, m), NEVER), np.full((width + 1, m), NEVER)
        back, ids = np.zeros((width + 1, m), np.int32), np.full((width + 1, m), -1, np.int32)
        best[0] = 0

        def relax(start, end, which, cost, piece):
            total, other = best[start, which] + cost, second[start, which] + cost
            old, runner = best[end, which], second[end, which]
            less = total < old
            second[end, which] = np.where(less, np.minimum(old, other), np.minimum(runner, total))
            best[end, which] = np.where(less, total, old)
            back[end, which] = np.where(less, start, back[end, which])
            ids[end, which] = np.where(less, piece, ids[end, which])

        for start in range(width):
            which = np.arange(reach[start])
            node = tree.child(np.zeros(len(which), np.int64), codes[start, which])
            single = (node < 0) | (tree.piece[node] < 0)
            relax(start, start + 1, which, np.where(single, v.spelt, tree.cost[node]), np.where(single, -1, tree.piece[node]))
            for end in range(start + 2, width + 1):
                going = (node >= 0) & (which < reach[end - 1])
                which, node = which[going], node[going]
                if not len(which):
                    break
                node = tree.child(node, codes[end - 1, which])
                found = np.flatnonzero((node >= 0) & (tree.piece[node] >= 0))
                if len(found):
                    relax(start, end, which[found], tree.cost[node[found]], tree.piece[node[found]])

        at, rows = lengths.copy(), np.arange(m)
        cost = best[at, rows]
        more = second[at, rows] - cost
        steps, spelt = [], np.zeros(m, bool)
        while len(rows):
            here = ids[at[rows], rows]
            steps.append((rows, here))
            spelt[rows[here < 0]] = True
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        owner = np.concatenate([r for r, _ in steps][::-1])
        found = np.concatenate([i for _, i in steps][::-1])[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=m)).tolist()
        cost, more, first = cost.tolist(), more.tolist(), 0
        for place, i in enumerate(some):
            if not spelt[place]:
                out[i] = (found[first : ends[place]], cost[place], more[place] if more[place] < NEVER // 2 else None)
            first = ends[place]
    return [best_of(chunks[i], v) if o is None else o for i, o in enumerate(out)]


def n_best(chunk: str, n: int, v: Vocabulary) -> list[tuple[int, list[int]]]:
    """The n best segmentations (cost, ids), cheapest first, by backward A-star search.

    A hypothesis covers the chunk from a position to the end; its cost so far plus the forward cost of the position
    is the cost of its best completion. Of equal totals the one found last is expanded first, and longer pieces
    before shorter ones, so the first result is that of ``best_of``. Hypotheses have no completion in common, so none
    behind the first n open ones can be among the n best: only those are kept, whatever the length of the chunk.
    """
    best, _, _ = forward(chunk, v)
    ends, parents = array("q", [len(chunk)]), array("q", [-1])  # of every hypothesis expanded
    heap = [(best[-1], 0, len(chunk), 0, -1)]
    pushed, out = 0, []
    while heap and len(out) < n:
        total, _, at, cost, parent = heap.pop(0)
        if at == 0:
            cuts = [0]
            while parent >= 0:
                cuts.append(ends[parent])
                parent = parents[parent]
            out.append((total, _ids(chunk, cuts, v)))
            continue
        here = len(ends)
        ends.append(at)
        parents.append(parent)
        for start in range(at - 1, max(0, at - v.longest) - 1, -1):
            edge = v.costs.get(chunk[start:at], v.spelt if start == at - 1 else -1)
            if edge >= 0 and best[start] < NEVER:
                pushed -= 1
                bisect.insort(heap, (best[start] + edge + cost, pushed, start, cost + edge, here))
        del heap[n - len(out) :]
    return out


def _edit(best: list[int], other: list[int]) -> tuple[int, int, list[int]]:
    """Where ``other`` leaves ``best``, how many ids of ``best`` go there, and the ids that take their place."""
    low, high = 0, min(len(best), len(other))
    while low < high and best[low] == other[low]:
        low += 1
    same = 0
    while same < high - low and best[-1 - same] == other[-1 - same]:
        same += 1
    return low, len(best) - low - same, other[low : len(other) - same]


class Encoder:
    """Best segmentations of chunks, remembered: row of a chunk, and per row its ids, cost and second cost."""

    def __init__(self, vocabulary: Vocabulary, n: int = BEST):
        self.v, self.n = vocabulary, n
        self.start_anew()

    def start_anew(self) -> None:
        encoder = self

        class Rows(dict):
            def __missing__(self, chunk):
                encoder.fresh.append(chunk)
                self[chunk] = row = len(self)
                return row

        self.rows = Rows()
        self.ids, self.starts, self.costs, self.more = array("i"), array("q", [0]), array("q"), array("q")
        self.fresh: list[str] = []  # chunks with a row and no segmentation yet
        self.searched: dict[str, list] = {}

    def settle(self) -> None:
        """Segment the fresh chunks."""
        for ids, cost, more in best_of_many(self.fresh, self.v):
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
            self.costs.append(cost)
            self.more.append(-1 if more is None else more)
        self.fresh = []

    def others(self, chunks: list[str], more: np.ndarray, places: np.ndarray) -> list[tuple[int, list]]:
        """What follows the best segmentation: (extra cost, edits (at, drop, ids)), cheapest first.

        ``places`` holds the place of each chunk's first id, and one more. Ties go to the earlier change. An edit spans
        only the ids that differ.
        """
        can = np.flatnonzero(more >= 0)
        if self.n < 2 or not len(can):
            return []
        if len(can) >= self.n:
            cheap = np.partition(more[can], self.n - 2)[self.n - 2]
            can = can[more[can] <= cheap]
        chosen = sorted(can[np.argsort(more[can], kind="stable")][: self.n - 1].tolist())
        hypotheses = [(0, ())]
        for c in chosen:
            chunk = chunks[c]
            if chunk not in self.searched:
                found = n_best(chunk, self.n, self.v)
                self.searched[chunk] = [(cost - found[0][0], *_edit(found[0][1], ids)) for cost, ids in found[1:]]
            change = [(0, ())] + [(found[0], ((c, r),)) for r, found in enumerate(self.searched[chunk])]
            hypotheses = heapq.nsmallest(self.n, ((a + b, x + y) for a, x in hypotheses for b, y in change))
        out = []
        for extra, changes in hypotheses[1:]:
            edits = []
            for c, r in changes:
                _, at, drop, ids = self.searched[chunks[c]][r]
                edits.append({"at": int(places[c]) + at, "drop": drop, "ids": ids})
            out.append((extra, edits))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], list[list]]:
        """Ids of all texts, where each text starts (one more at the end), scores, and the other segmentations."""
        if len(self.rows) > CACHED:
            self.start_anew()
        elif len(self.searched) > CACHED // 16:
            self.searched = {}
        chunks = [CHUNKS.findall(f" {t}") if t else [] for t in texts]
        counts = np.array([len(c) for c in chunks], np.int64)
        get = self.rows.__getitem__
        rows = np.fromiter((get(c) for text in chunks for c in text), np.int64, counts.sum())
        self.settle()
        starts = np.array(self.starts)
        lengths = starts[rows + 1] - starts[rows]
        places = np.concatenate([[0], np.cumsum(lengths)])
        pick = np.repeat(starts[rows] - places[:-1], lengths) + np.arange(places[-1])
        ids = np.frombuffer(self.ids, np.int32)[pick] if len(pick) else np.zeros(0, np.int32)
        costs, more = (np.frombuffer(x, np.int64)[rows] if len(rows) else rows for x in (self.costs, self.more))
        ends = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], np.cumsum(costs)])
        scores, others = [], []
        for t, (a, b) in enumerate(zip(ends, ends[1:])):
            cost = int(sums[b] - sums[a])
            scores.append(-cost / UNIT)
            found = self.others(chunks[t], more[a:b], places[a : b + 1] - places[a])
            others.append([{"score": -(cost + extra) / UNIT, "edits": edits} for extra, edits in found])
        return ids, places[ends], scores, others


def _groups(texts: list[str]):
    """Ranges of texts of about CHUNK characters; a longer text stands alone."""
    low = size = 0
    for high, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield low, high
            low, size = high, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


OTHERS = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
        ]
    )
)


def encoding(vocabulary: Vocabulary, text: Column | str = "text", n: int = BEST, check: bool = False) -> Column:
    """Column struct(ids, score, others) for a text, with ``check`` also round_trip: whether the decoded ids give the text.

    ``ids`` is the best segmentation and ``score`` minus its cost. ``others`` holds up to n - 1 further ones in order
    of their score: each replaces ``drop`` ids of the best from place ``at`` (from 0) by ``ids``, for every edit. A
    null or empty text has no ids, score 0 and no others.
    """
    kept: list[Encoder] = []
    # where the ids were made, as a second function would have a Python process of its own
    decode = decoder(vocabulary) if check else None

    def encode(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Encoder(vocabulary, n))
        values = texts.to_pylist()
        parts = []
        for low, high in _groups(values):
            ids, starts, scores, others = kept[0].encode(values[low:high])
            listed = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            fields = {"ids": listed, "score": pa.array(scores, pa.float64()), "others": pa.array(others, OTHERS)}
            if decode:
                fields["round_trip"] = pc.equal(decode(listed), pa.array(values[low:high], pa.string()))
            parts.append(pa.StructArray.from_arrays([*fields.values()], [*fields]))
        kind = [("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("others", OTHERS)] + [("round_trip", pa.bool_())] * check
        return pa.concat_arrays([p.cast(pa.struct(kind)) for p in parts]) if parts else pa.array([], pa.struct(kind))

    result = f"{ENCODED},round_trip:boolean>" if check else f"{ENCODED}>"
    return F.arrow_udf(encode, result).asNondeterministic()(text_of(text))


def decoder(vocabulary: Vocabulary):
    """Function from Arrow lists of ids to their texts."""
    sizes = np.array([len(t) for t in vocabulary.text], np.int64)
    firsts = np.cumsum(sizes) - sizes
    written = np.frombuffer(b"".join(vocabulary.text), np.uint8)

    def decode(lists: pa.Array) -> pa.Array:
        valid = np.asarray(lists.is_valid())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes)):
            raise IndexError("id beyond the vocabulary")
        ends = np.cumsum(np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0))
        ends = np.concatenate([[0], ends]).astype(np.int64)
        out = []
        low = 0
        while low < len(lists):
            # as many lists as have some CHUNK ids, one at least
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + CHUNK, "right")) - 1)
            here = flat[ends[low] : ends[high]]
            total = np.concatenate([[0], np.cumsum(sizes[here])])
            pick = np.repeat(firsts[here] - total[:-1], sizes[here]) + np.arange(total[-1])
            whole = written[pick].tobytes()
            cuts = total[ends[low : high + 1] - ends[low]].tolist()
            for a, b, known in zip(cuts, cuts[1:], valid[low:high]):
                out.append(whole[a + (a < b and whole[a] == 32) : b].decode("utf-8", "replace") if known else None)
            low = high
        return pa.array(out, pa.string())

    return decode


def decoding(vocabulary: Vocabulary, ids: Column | str = "ids") -> Column:
    """Column with the text of ids. Null ids give null; ids beyond the vocabulary fail; broken bytes become U+FFFD."""
    decode = decoder(vocabulary)

    def work(lists: pa.Array) -> pa.Array:
        return decode(lists)

    return F.arrow_udf(work, "string")(F.col(ids) if isinstance(ids, str) else ids)


def encode(docs: DataFrame, path: str = MODEL, n: int = BEST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pieces, score, ids, others, round_trip.

    ``round_trip`` says whether decoding the ids gives the text (a null text counts as empty). Repeated rows are
    encoded alike, extra columns are ignored, an empty table gives an empty result.
    """
    small_batches(docs)
    vocabulary = load(path)
    encoded = docs.select("doc_id", encoding(vocabulary, "text", n, check=True).alias("e"))
    return encoded.select(
        "doc_id",
        F.size("e.ids").alias("n_pieces"),
        "e.score",
        "e.ids",
        "e.others",
        "e.round_trip",
    )
