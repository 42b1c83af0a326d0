"""Near duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct five-word shingles; its sketch the ``SKETCH`` smallest.
Documents with equal sets form a class, and only classes are compared.

1. Inverted lists hold the classes by each of their ``LISTED`` smallest values (upper halves), the head. Of two sets
   with a similarity of 0.75, each of the smallest values of the union is shared with probability 0.75: of 16 they
   share fewer than ``SHARED`` with 4e-6. Pairs with fewer are dropped, and full sets are made only of classes with
   that many shared lists.
2. In each list all classes are proposed to one hub, the class whose values are the most common (then with the
   most copies), and verified. A group of thousands of copies becomes one component without its pairs.
3. What is left are pairs of different components within a list. Short lists emit their pairs. Long lists, of the
   first ``LONG_PLACES`` values (none is shared with 1e-6), are cut into blocks of classes; a task compares two
   blocks by the union sketches in numpy and emits only pairs that may be links. Blocks within a list's largest
   component are not compared among themselves.
4. Every pair is verified on the full sets, and links become components.

No list, class or component is gathered in one task; lists of any length are worked off.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.llm.arrays import bytes_of, small_batches
from scoremill.llm.components import components
from scoremill.session import stage

SHINGLE = 5
PERCENT = 75
SKETCH = 256
LISTED = 16
SHARED = 4  # values of the heads that a linked pair shares
LONG_PLACES = 10
SHORT_LIST = 64  # classes in a list whose pairs are emitted
BLOCK = 512  # classes of a long list compared with as many others in one task
SIGMAS = 4.5  # standard errors by which an estimate may fall short
CHUNK = 4 << 20  # bytes of text hashed at a time

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one (the finishing step of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. A word never crosses texts."""
    space = _SPACE[data]
    first = ~space
    if len(data):
        first[1:] &= space[:-1]
    border = starts[:-1]
    border = border[border < len(data)]
    first[border] = ~space[border]
    last = np.empty_like(space)
    last[:-1] = ~space[:-1] & (space[1:] | first[1:])
    last[-1:] = ~space[-1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(data) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, n)[:-1], out=sums[1:], dtype=np.uint64)
    back = _powers(pow(_BASE, -1, 1 << 64), n)
    words = _mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return words, np.diff(np.searchsorted(begin, starts))


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; of its whole sequence if it has fewer words."""
    words, counts = word_hashes(data, starts)
    total = len(words)
    rolled = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        rolled[: max(total - k, 0)] += words[k:] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    rolled = _mix(rolled)
    out, at = [], 0
    for n in counts:
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            short = words[at : at + n] * np.array([pow(_BASE, k + 1, 1 << 64) for k in range(n)], np.uint64)
            out.append(_mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(rolled[:0])
        at += n
    return out


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _pieces(starts: np.ndarray):
    """Ranges of texts of about CHUNK bytes; a longer text stands alone."""
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK, "right")) - 1)
        yield low, high
        low = high


def _sets(batch):
    """Ranges of rows of a batch with the sorted shingle sets of their texts."""
    data, starts = bytes_of(batch.column("text").fill_null(""))
    for low, high in _pieces(starts):
        yield low, high, shingle_sets(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def _headed(batches):
    for batch in batches:
        for low, high, sets in _sets(batch):
            heads = [(s[:LISTED] >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class(s) for s in sets], pa.binary()),
                    _lists(heads, pa.int32()),
                ],
                ["doc_id", "n_shingles", "class", "head"],
            )


def _full(batches):
    for batch in batches:
        for low, high, sets in _sets(batch):
            wanted = batch.column("class").slice(low, high - low).to_pylist()
            kept = [(c, s) for c, s in zip(wanted, sets) if c == _class(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c, _ in kept], pa.binary()),
                    pa.array([len(s) for _, s in kept], pa.int64()),
                    _lists([s.view(np.int64) for _, s in kept], pa.int64()),
                ],
                ["class", "n_shingles", "shingles"],
            )


def heads(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set, null if empty) and head, the smallest values of the sketch."""
    small_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_shingles bigint, class binary, head array<int>"
    return docs.select("doc_id", "text").mapInArrow(_headed, shape)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, n_shingles and the sorted set (as signed numbers) of the wanted classes (class, least_id)."""
    ids = wanted.select("class", F.col("least_id"))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("least_id")))
    return texts.select("class", "text").mapInArrow(_full, "class binary, n_shingles bigint, shingles array<bigint>")


def _similar_size(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _least_shared(n: Column) -> Column:
    """Values that the heads of a link must share, at least, if the larger set has ``n``."""
    return F.least(F.lit(SHARED), F.ceil(n * PERCENT / 100))


def _may_link(head_a: str, head_b: str, n_a: str, n_b: str) -> Column:
    shared = F.size(F.array_intersect(head_a, head_b))
    return _similar_size(n_a, n_b) & (shared >= _least_shared(F.greatest(n_a, n_b)))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links, by their full sets."""
    left = sets.toDF("class_a", "n_a", "set_a")
    right = sets.toDF("class_b", "n_b", "set_b")
    joined = pairs.join(left, F.col("a") == F.col("class_a")).join(right, F.col("b") == F.col("class_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        joined.where(_similar_size("n_a", "n_b"))
        .withColumn("shared", shared)
        .where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * PERCENT)
        .select("a", "b")
    )


def _weigh(mine: list[np.ndarray], other: list[np.ndarray], own_size, other_size) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches (sorted, unsigned) may belong to a link, and which surely do.

    Up to the smaller of two sketches' largest values both sketches are complete, so the values there are the
    sketch of the union; the share of common ones estimates the similarity, exactly if both sets fit. Then a pair is
    sure if it stays a link without one of the common values, should two shingles have met in it.
    """
    values, places, counts = np.unique(np.concatenate([*mine, *other]), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # values of one sketch only are common to none
    grid = np.zeros((len(mine) + len(other), int(column[-1]) + 1 if len(column) else 0), np.float32)
    rows = np.repeat(np.arange(len(grid)), [len(s) for s in (*mine, *other)])
    twice = counts[places] > 1
    grid[rows[twice], column[places[twice]]] = 1
    common = (grid[: len(mine)] @ grid[len(mine) :].T).astype(np.int64)
    whole = np.int64(1) << 40
    top = lambda s, n: np.where(n > SKETCH, [int(x[-1]) for x in s], whole)
    limit = np.minimum(top(mine, own_size)[:, None], top(other, other_size)[None, :])
    mine_in = np.array([np.searchsorted(s, limit[i], "right") for i, s in enumerate(mine)])
    other_in = np.array([np.searchsorted(s, limit[:, j], "right") for j, s in enumerate(other)]).T
    union = mine_in + other_in - common
    share = PERCENT / 100
    spare = np.where(limit == whole, 0.01, SIGMAS * np.sqrt(share * (1 - share) / np.maximum(union, 1)) + 0.01)
    sizes = np.minimum(own_size[:, None], other_size[None, :]) >= share * np.maximum(own_size[:, None], other_size)
    sure = (limit == whole) & ((common - 1) * 100 >= (union + 1) * PERCENT)
    return (common >= (share - spare) * union) & sizes, sure & sizes


def _joining(pairs: list[tuple[int, int]], group: list[int]):
    """The pairs that join two groups; ``group`` is a forest over the labels and is changed."""
    for at, (x, y) in enumerate(pairs):
        x, y = _root(group, x), _root(group, y)
        if x != y:
            group[y] = x
            yield at


def _root(group: list[int], node: int) -> int:
    while group[node] != node:
        group[node] = group[group[node]]
        node = group[node]
    return node


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Pairs of two blocks of one list that may be links and join different components.

    Sure links are given only as far as they join components that earlier ones have not joined, and others only
    between what the sure ones leave apart: a block gives no more sure pairs than it has components.
    """
    names = np.array(table.column("class").to_pylist(), dtype=object)
    labels = np.array(table.column("label").to_pylist(), dtype=object)
    sizes = table.column("n_shingles").to_numpy()
    sides = table.column("side").to_numpy()
    sets = [np.asarray(s, np.int32).view(np.uint32) for s in table.column("sketch").to_pylist()]
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    out_a, out_b = [], []
    if len(left) and len(right):
        may, sure = _weigh([sets[i] for i in left], [sets[i] for i in right], sizes[left], sizes[right])
        _, label = np.unique(labels.astype("S16"), return_inverse=True)
        apart = label[left][:, None] != label[right][None, :]
        group = list(range(int(label.max()) + 1))
        for some, joins in ((sure & apart, True), (may & ~sure & apart, False)):
            i, j = np.nonzero(some)
            ends = np.stack([label[left[i]], label[right[j]]], 1)
            if joins:  # one pair for each two components is enough
                _, first = np.unique(ends, axis=0, return_index=True)
                chosen = [first[n] for n in _joining(ends[first].tolist(), group)]
            else:
                root = np.array([_root(group, n) for n in range(len(group))])
                chosen = np.flatnonzero(root[ends[:, 0]] != root[ends[:, 1]])
            for n in chosen:
                a, b = sorted((names[left[i[n]]], names[right[j[n]]]))
                out_a.append(a)
                out_b.append(b)
    return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})


def _hub_links(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes and the hubs of their lists. ``entries``: value, class, n_shingles, head, weight, copies."""
    hub = F.struct("weight", "copies", F.col("class").alias("hub"), F.col("n_shingles").alias("hub_size"), F.col("head").alias("hub_head"))
    hubs = entries.groupBy(F.col("value").alias("hub_value")).agg(F.max(hub).alias("h"))
    hubs = hubs.select("hub_value", "h.hub", "h.hub_size", "h.hub_head")
    pairs = (
        entries.drop("weight", "copies")
        .join(hubs, F.col("value") == F.col("hub_value"))
        .where((F.col("class") != F.col("hub")) & _may_link("hub_head", "head", "hub_size", "n_shingles"))
        .select(F.col("hub").alias("a"), F.col("class").alias("b"))
        .distinct()
    )
    return _verified(pairs, sets)


def _upper_halves(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.shiftright(s, 32).cast("int"))


def _rest_pairs(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that may be links. ``entries``: value, place, class, n_shingles, head, label."""
    by_label = entries.groupBy("value", "label").agg(F.count("*").alias("n"))
    lists = (
        by_label.groupBy("value")
        .agg(F.sum("n").alias("members"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"))
        .where("labels > 1")
        .select(F.col("value").alias("list"), "members", F.col("top.label").alias("core"), F.col("top.n").alias("n_core"))
    )
    open_entries = stage(entries.join(lists, F.col("value") == F.col("list")).drop("list"))

    short = open_entries.where(F.col("members") <= SHORT_LIST).select("value", "class", "n_shingles", "head", "label")
    pairs = (
        short.toDF("value", "a", "n_a", "head_a", "label_a")
        .join(short.toDF("value", "b", "n_b", "head_b", "label_b"), "value")
        .where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")))
        .where(_may_link("head_a", "head_b", "n_a", "n_b"))
        .select("a", "b")
    )

    is_core = F.col("label") == F.col("core")
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    mine = F.when(is_core, F.lit(-1)).otherwise(F.pmod(F.hash("class"), F.col("n_out")))
    tasks = F.when(
        is_core,
        # a core block meets every other block
        F.transform(
            F.sequence(F.lit(0), F.col("n_out") - 1),
            lambda o: F.struct(
                o.alias("first"), (-1 - F.pmod(F.hash("class"), F.col("n_in"))).alias("second"), F.lit(1).alias("side")
            ),
        ),
    ).otherwise(
        F.concat(
            F.transform(
                F.sequence(F.lit(1), F.col("n_in")),
                lambda c: F.struct(F.col("block").alias("first"), (-c).alias("second"), F.lit(0).alias("side")),
            ),
            F.transform(
                F.sequence(F.lit(0), F.col("n_out") - 1),
                lambda o: F.struct(
                    F.least("block", o).alias("first"),
                    F.greatest("block", o).alias("second"),
                    # side 2 stands on both sides: the block meets itself
                    F.when(F.col("block") == o, 2).when(F.col("block") < o, 0).otherwise(1).alias("side"),
                ),
            ),
        )
    )
    long_lists = (
        open_entries.where((F.col("members") > SHORT_LIST) & (F.col("place") < LONG_PLACES))
        .withColumn("n_out", blocks(F.col("members") - F.col("n_core")))
        .withColumn("n_in", blocks(F.col("n_core")))
        .withColumn("block", mine)
        .withColumn("task", F.explode(tasks))
        .select("value", "class", "n_shingles", "label", "task.first", "task.second", "task.side")
    )
    sketches = sets.select(F.col("class").alias("of_class"), _upper_halves(F.slice("shingles", 1, SKETCH)).alias("sketch"))
    compared = (
        long_lists.join(sketches, F.col("class") == F.col("of_class"))
        .drop("of_class")
        .groupBy("value", "first", "second")
        .applyInArrow(_compare_blocks, "a binary, b binary")
    )
    return pairs.union(compared).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space with A-Z in lower case; a set holds the distinct five-word
    shingles, or the whole sequence of a shorter text. Rows are linked if their sets share 75 percent of their
    union. ``component_id`` is the smallest doc_id a row reaches, ``kept`` marks the row that has it. A null or
    empty text has no shingles, is linked with nothing and is kept. A component without any doc_id keeps its rows.
    Repeated rows are copies of each other and share one component. Extra columns are ignored. An empty table gives
    an empty result; texts of any length are read whole.
    """
    return _decided(docs).drop("class")


def _decided(docs: DataFrame) -> DataFrame:
    """What :func:`near_duplicates` returns, with each row's class."""
    rows = stage(heads(docs))
    classes = stage(
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("head").alias("head"),
            F.count("*").alias("copies"),
        )
    )
    listed = classes.select("class", "n_shingles", "head", "copies", F.posexplode("head").alias("place", "value"))
    shared = listed.groupBy(F.col("value").alias("list")).agg(F.count("*").alias("members")).where("members > 1")
    entries = stage(listed.join(shared, F.col("value") == F.col("list")).drop("list"))
    suspects = entries.groupBy(F.col("class").alias("suspect")).agg(
        F.sum("members").alias("weight"), F.count("*").alias("n"), F.first("n_shingles").alias("size")
    )
    suspects = stage(suspects.where(F.col("n") >= _least_shared(F.col("size"))).drop("n", "size"))
    entries = stage(entries.join(suspects, F.col("class") == F.col("suspect")).drop("suspect", "members"))
    wanted = classes.join(suspects, F.col("class") == F.col("suspect"), "left_semi")
    sets = stage(full_sets(docs, wanted))

    links = stage(_hub_links(entries, sets))
    labels = components(links)
    labelled = (
        entries.join(labels, F.col("class") == F.col("node"), "left")
        .withColumn("label", F.coalesce("label", "class"))
        .drop("node", "weight", "copies")
    )
    more = stage(_verified(_rest_pairs(labelled, sets), sets))
    found = components(links.union(more))
    least = (
        classes.join(found, F.col("class") == F.col("node"), "left")
        .withColumn("label", F.coalesce("label", "class"))
        .select("class", "least_id", "label")
    )
    ids = least.groupBy(F.col("label").alias("of_label")).agg(F.min("least_id").alias("component"))
    of_class = (
        least.join(ids, F.col("label") == F.col("of_label")).select(F.col("class").alias("of_class"), "component")
    )
    return (
        rows.select("doc_id", "n_shingles", "class")
        .join(of_class, F.col("class") == F.col("of_class"), "left")
        .select(
            "doc_id",
            "n_shingles",
            "class",
            F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        )
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )


def _classes(texts: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    return pa.array([_class(s) for _, _, sets in _sets(batch) for s in sets], pa.binary())


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns unchanged.

    Every row's own decision counts: the row with the smallest doc_id of its group stays, and rows without a doc_id go
    where their group has one. In a group without any doc_id one row of each set of shingles stays. Of rows that repeat
    a doc_id with the same set, or the same text without words, one stays. Texts are read whole; an empty table gives
    an empty result, and extra columns go along, whatever their names.
    """
    kept = _decided(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("class").alias("kept_class"))
    class_of = F.arrow_udf(_classes, "binary").asNondeterministic()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        docs["doc_id"].alias("id"),
        class_of(docs["text"]).alias("set"),
    )
    same = F.col("id").eqNullSafe(F.col("kept_id")) & F.col("set").eqNullSafe(F.col("kept_class"))
    stays = whole.join(kept.distinct(), same, "left_semi")
    wordless = F.when(F.col("set").isNull(), F.md5(F.col("doc.text").cast("binary")))
    return stays.groupBy("id", "set", wordless).agg(F.first("doc").alias("doc")).select("doc.*")
