"""Classifier chain: out-of-fold training, held-out accuracy, and odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from scoremill.llm import toxicity


def test_linear_model_finds_its_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20000, 3))
    y = (rng.random(20000) < toxicity._sigmoid(x @ [1.0, -2.0, 0.0] + 0.5)).astype(float)
    assert np.allclose(toxicity.fit_linear(x, y), [1, -2, 0, 0.5], atol=0.1)


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 5)).astype(float)
    y = np.stack([x[:, 0], (rng.random(600) < 0.5).astype(float), x[:, 1]], 1)
    folds = np.arange(600) % 5
    weights, out = toxicity.fit_chain(x, y, folds)
    assert [len(w) for w in weights] == [6, 7, 8]
    for fold in range(5):
        held = folds == fold
        w = toxicity.fit_linear(x[~held], y[~held, 0])
        assert np.allclose(out[held, 0], toxicity._sigmoid(x[held] @ w[:-1] + w[-1]))
        w = toxicity.fit_linear(np.concatenate([x, out[:, :1]], 1)[~held], y[~held, 1])
        fed = np.concatenate([x, out[:, :1]], 1)[held]
        assert np.allclose(out[held, 1], toxicity._sigmoid(fed @ w[:-1] + w[-1]))
    chain = toxicity.Chain({f"f{i}": i for i in range(5)}, weights)
    p = chain.probabilities(x)
    first = toxicity._sigmoid(x @ weights[0][:-1] + weights[0][-1])
    assert np.allclose(p[:, 0], first)
    assert np.allclose(p[:, 1], toxicity._sigmoid(np.c_[x, first] @ weights[1][:-1] + weights[1][-1]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = toxicity.score(docs, labels.where(~held))
    r = (
        out.join(labels.where(held), "doc_id")
        .agg(
            F.avg(F.when(F.col("toxic") == 1, F.col("toxic_pred").cast("int"))).alias("caught"),
            F.avg(F.when(F.col("toxic") == 0, F.col("toxic_pred").cast("int"))).alias("wrong"),
            F.count(F.when(F.col("toxic") == 1, 1)).alias("n"),
        )
        .first()
    )
    assert r["n"] > 30 and r["caught"] > 0.9 and r["wrong"] < 0.01


def test_odd_rows(spark):
    docs = [(i, ("You idiot, what a moron " if i % 4 == 0 else "A calm and friendly note ") + f"n{i}", 9) for i in range(80)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 1, 7), (5, 1, 0), (900, 1, 1)]
    docs += [(100, None, 9), (101, "", 9), (102, "idiot " * 50000, 9), (103, "idiot", 9), (103, "idiot", 9), (None, "calm", 9)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == 86
    flagged = {r["doc_id"] for r in out if r["toxic_pred"]}
    assert flagged == {i for i in range(0, 80, 4)} | {102, 103}
    assert all(0 <= r[f"p_{c}"] <= 1 for r in out for c in toxicity.CATEGORIES)
    none = labels.where("doc_id < 0")
    assert toxicity.score(docs, none).where("toxic_pred").count() == 0
    assert toxicity.score(docs.where("doc_id < 0"), labels).count() == 0
