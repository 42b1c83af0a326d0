"""Graph search against brute force: recall, scores, order, and odd inputs."""

import numpy as np
import pytest

from scoremill.llm import neighbours


def exact(rows, every=20, k=20):
    """query id -> [(score, id)], nearest first, for (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            near = (x * v).sum(1)
            order = np.lexsort((ids, -near))
            out[int(i)] = [(near[j], int(ids[j])) for j in order if ids[j] != i][:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found = out.setdefault(r["query_id"], [])
        found.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found)
    return out


def recall(found, wanted):
    hit = sum(len({i for _, i in found.get(q, [])} & {i for _, i in w}) for q, w in wanted.items())
    return hit / sum(map(len, wanted.values()))


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    wanted = exact([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    found = result(neighbours.nearest(rows))
    assert found.keys() == wanted.keys() and all(len(f) == 20 for f in found.values())
    assert recall(found, wanted) > 0.95
    scores = {q: {i: s for s, i in exact_} for q, exact_ in wanted.items()}
    for q, f in found.items():
        assert f == sorted(f, key=lambda p: (-p[0], p[1]))
        assert all(abs(s - scores[q][i]) < 1e-12 for s, i in f if i in scores[q])


def test_recall_with_lengths_and_a_cluster():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))
    x[:900] = x[0] + rng.normal(size=(900, 24)) * 0.01
    x = x.astype(np.float32)
    ids, _ = neighbours.search(x, neighbours.build(x), x[::50], 20)
    true = np.argsort(-(x[::50] @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, true)]) > 0.9


def test_odd_rows(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    rows = [(i, v, "q") for i, v in good] + [(0, good[0][1], "q"), (20, good[20][1], "q")]
    rows += [(100, None, "q"), (120, [0.0, 0.0, 0.0], "q"), (140, [1.0, None, 2.0], "q"), (160, [1.0, float("nan"), 2.0], "q")]
    rows += [(180, [1.0, float("inf"), 0.0], "q"), (None, [1.0, 1.0, 1.0], "q"), (200, [], "q"), (220, [1.0, 2.0], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    found = result(neighbours.nearest(df))
    wanted = exact(good)
    assert found == wanted  # the lone vector of two components has no candidate


def test_equal_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(401, [2.0, 4.0]), (402, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(neighbours.nearest(df)) == exact(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert result(neighbours.nearest(few)) == exact(rows[:3])
    assert neighbours.nearest(df.where("vec_id < 0")).count() == 0


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-3, 0]], np.float32)
    level, reach = neighbours._level(x)
    kept = neighbours.robust_prune(level, np.array([0]), np.array([[1, 2, 3, 4, -1, 1, 0]]), reach)
    assert {0, 2}.isdisjoint(kept[0]) and {1, 3} <= set(kept[0].tolist())


@pytest.mark.parametrize("n", [1, 2, 33, 200])
def test_small_graphs(n):
    x = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    ids, near = neighbours.search(x, neighbours.build(x), x, 5)
    assert ids.shape == (n, min(n, 5)) and (np.diff(near, axis=1) <= 0).all()
