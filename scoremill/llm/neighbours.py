"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Equal vectors are one node; their smallest ids stand for them. Nodes are dealt to shards by hash. In a shard every
vector gets one more component that makes all lengths equal, so that the largest inner product is the smallest
distance. Nodes enter the graph in batches that at most double it: a greedy beam search proposes neighbours, the other
nodes of the batch are proposed too, and relaxed distance pruning keeps a neighbour only if no kept one is ``ALPHA``
times closer to it than the node is. Edges back are added and pruned alike. Queries search every shard with a beam
that starts at the best of some entry nodes; the shards' best are merged.

A shard's number grows with the square root of the nodes' number, so do the shards' sizes; blocks of queries bound
what a search task holds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoremill.session import stage

NEAREST = 20
EVERY = 20  # rows whose id it divides are queries
DEGREE = 32
BEAM = 64  # of a search for neighbours while building
SEARCH_BEAM = 128
ALPHA = 1.2
ENTRIES = 256
BATCH = 512
SHARD_ROOT = 16  # shards: square root of the number of nodes, divided by this
QUERY_BLOCK = 20_000
FAR = np.float32(-np.inf)


def beam_search(vectors, graph, targets, width, entries):
    """Ids (-1: none) and products of the ``width`` best nodes found for each target, best first."""
    n, m = len(vectors), len(targets)
    width = min(width, n)
    first = targets @ vectors[entries].T
    seen = np.zeros((m, n), bool)
    seen[:, entries] = True
    take = np.argsort(-first, 1, kind="stable")[:, :width]
    ids = np.full((m, width), -1)
    near = np.full((m, width), FAR, np.float32)
    ids[:, : take.shape[1]] = entries[take]
    near[:, : take.shape[1]] = np.take_along_axis(first, take, 1)
    done = ids < 0
    active = np.arange(m)
    while len(active):
        best = np.argmax(~done[active], 1)
        open_ = ~done[active, best]
        active, best = active[open_], best[open_]
        if not len(active):
            break
        done[active, best] = True
        around = graph[ids[active, best]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        near_new = np.where(fresh, np.einsum("ard,ad->ar", vectors[around], targets[active]), FAR)
        seen[active[:, None], np.where(around >= 0, around, ids[active, best][:, None])] = True
        # a node named twice in one list counts once: lists hold no repeats
        all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], 1)
        all_near = np.concatenate([near[active], near_new], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        order = np.argsort(-all_near, 1, kind="stable")[:, :width]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        near[active] = np.take_along_axis(all_near, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    return ids, near


def robust_prune(vectors, nodes, candidates, reach, degree=DEGREE, alpha=ALPHA):
    """Up to ``degree`` diverse neighbours of each node out of ``candidates`` (-1: none), -1 where there are fewer.

    ``reach`` is half the squared length that all vectors share: distances are reach minus products, times two.
    """
    own = vectors[nodes]
    given = vectors[candidates]
    gap = 2 * (reach - np.einsum("ncd,nd->nc", given, own))
    gap = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, np.maximum(gap, 0))
    order = np.argsort(gap, 1, kind="stable")
    candidates, gap = np.take_along_axis(candidates, order, 1), np.take_along_axis(gap, order, 1)
    again = np.zeros_like(gap, bool)
    by_id = np.argsort(candidates, 1, kind="stable")
    sorted_ids = np.take_along_axis(candidates, by_id, 1)
    np.put_along_axis(again, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    alive = np.isfinite(gap) & ~again
    given = np.take_along_axis(given, order[:, :, None], 1)
    between = 2 * (reach - np.matmul(given, given.transpose(0, 2, 1)))
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmax(alive, 1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = candidates[has, pick[has]]
        alive &= ~((alpha * alpha * between[rows, pick] <= gap) & has[:, None])
        alive[rows, pick] = False
    return out


def _level(vectors):
    """Vectors with one more component so that all have the greatest length, and half that length squared."""
    squares = np.einsum("nd,nd->n", vectors, vectors)
    top = squares.max()
    extra = np.sqrt(np.maximum(top - squares, 0))
    return np.concatenate([vectors, extra[:, None]], 1).astype(np.float32), np.float32(top)


def build(vectors: np.ndarray) -> np.ndarray:
    """Neighbour lists (node x DEGREE, -1: none) over the vectors of one shard."""
    n = len(vectors)
    graph = np.full((n, DEGREE), -1)
    level, reach = _level(vectors)
    order = np.random.default_rng(0).permutation(n)
    done = 0
    while done < n:
        batch = order[done : done + min(BATCH, max(DEGREE, done))]
        mine = level[batch]
        among = np.argsort(-(mine @ mine.T), 1, kind="stable")[:, : BEAM + 1]
        candidates = batch[among]
        if done:
            entries = order[: min(done, ENTRIES)]
            found, _ = beam_search(level, graph, mine, BEAM, entries)
            candidates = np.concatenate([found, candidates], 1)
        graph[batch] = robust_prune(level, batch, candidates, reach)
        _add_back(graph, level, batch, reach)
        done += len(batch)
    return graph


def _add_back(graph, level, batch, reach):
    """Edges from the batch's new neighbours back to it; lists that overflow are pruned."""
    ends = graph[batch]
    source = np.repeat(batch, ends.shape[1])[ends.ravel() >= 0]
    target = ends.ravel()[ends.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    for width in np.unique(np.minimum(counts, BATCH)):
        pick = np.minimum(counts, BATCH) == width
        new = source[first[pick][:, None] + np.arange(width)]
        some = nodes[pick]
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            merged = np.concatenate([graph[part], new[at : at + BATCH]], 1)
            graph[part] = robust_prune(level, part, merged, reach)


def search(vectors: np.ndarray, graph: np.ndarray, targets: np.ndarray, k: int):
    """Rows and products (in double precision) of the ``k`` best nodes found for each target, -1 where none."""
    n = len(vectors)
    wide, _ = _level(vectors)
    flat = np.concatenate([targets, np.zeros((len(targets), 1))], 1).astype(np.float32)
    step = max(1, min(256, (64 << 20) // max(n, 1)))
    out_ids, out_near = [], []
    for at in range(0, len(targets), step):
        if n <= SEARCH_BEAM:
            ids = np.tile(np.arange(n), (len(flat[at : at + step]), 1))
        else:
            entries = np.random.default_rng(0).permutation(n)[:ENTRIES]
            ids, _ = beam_search(wide, graph, flat[at : at + step], SEARCH_BEAM, entries)
        exact = (vectors[ids].astype(np.float64) * targets[at : at + step, None].astype(np.float64)).sum(2)
        exact = np.where(ids < 0, -np.inf, exact)
        best = np.argsort(-exact, 1, kind="stable")[:, :k]
        out_ids.append(np.take_along_axis(ids, best, 1))
        out_near.append(np.take_along_axis(exact, best, 1))
    return np.concatenate(out_ids), np.concatenate(out_near)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    graph = build(_matrix(table.column("vector")))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(graph.ravel().astype(np.int32)), graph.shape[1])
    return table.append_column("near", lists.cast(pa.list_(pa.int32())))


def _search(k: int):
    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(nodes) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        nodes = nodes.sort_by("node")
        graph = nodes.column("near").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        ids, near = search(_matrix(nodes.column("vector")), graph, _matrix(queries.column("vector")), k)
        found = ids >= 0
        names = nodes.column("node").to_numpy()
        query = np.repeat(queries.column("query_id").to_numpy(), found.sum(1))
        return pa.table({"query_id": query, "node": names[ids[found]], "score": near[found]})

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector, dim) of rows with an id and a finite vector that is not zero, once per id and vector."""
    vector = F.col("embedding")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return (
        rows.select("vec_id", "embedding")
        .where("vec_id IS NOT NULL")
        .where(F.coalesce(whole & some, F.lit(False)))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.cast("array<float>").alias("vector"), F.size(vector).alias("dim"))
        .distinct()
    )


def index(nodes: DataFrame, shards: int) -> DataFrame:
    """``nodes`` (node, vector, dim) with their shard and neighbour list (places in their shard by node)."""
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    shape = "node bigint, vector array<float>, dim int, shard int, near array<int>"
    return dealt.groupBy("dim", "shard").applyInArrow(_build, shape)


def nearest(rows: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    ``rows`` has vec_id and embedding; extra columns are ignored. Queries are the rows whose id ``every`` divides, all
    other rows are candidates. Rows without an id, and vectors that are null, zero or hold a null, infinite or NaN
    component take no part; vectors of another length than the query's are no candidates. Ties go to the smaller id.
    Repeated rows (same id and vector) count once; rows that share an id are the query's own. Fewer candidates give
    fewer rows, an empty table none.
    """
    points = stage(usable(rows))
    nodes = points.groupBy("vector", "dim").agg(F.min("vec_id").alias("node"))
    nodes = stage(nodes.select("node", "vector", "dim"))
    by_node = Window.partitionBy("node").orderBy("vec_id")
    same = points.withColumnsRenamed({"vector": "of", "dim": "of_dim"})
    members = (
        same.join(nodes, (F.col("of") == F.col("vector")) & (F.col("of_dim") == F.col("dim")))
        .withColumn("place", F.row_number().over(by_node))
        .where(F.col("place") <= k + 1)  # one may be the query's own; further ones rank behind
        .select(F.col("node").alias("of_node"), "vec_id")
    )
    count = nodes.count()
    shards = max(1, math.ceil(math.sqrt(count) / SHARD_ROOT))
    graph = stage(index(nodes, shards))
    queries = points.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = graph.select("dim", "shard", "node", "vector", "near", block)
    right = queries.select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.hash("query_id"), F.lit(blocks)).alias("block"),
        "query_id",
        "vector",
    )
    found = (
        left.groupBy("dim", "shard", "block")
        .cogroup(right.groupBy("dim", "shard", "block"))
        .applyInArrow(_search(k + 1), "query_id bigint, node bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.join(members, F.col("node") == F.col("of_node"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
