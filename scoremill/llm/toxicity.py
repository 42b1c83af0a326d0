"""Toxicity by a classifier chain of linear models.

The chain predicts the categories in order; the probability of each is a feature of those after it. So that a later
model learns from probabilities as good as it will see, it is trained on out-of-fold ones: every training document's
comes from a model that has not seen it. Categories before the last are labelled by seed words within documents
labelled toxic; the last is the label itself.

Features are words and beginnings of words that occur in a document. Those most unevenly spread over the two labels
are kept, which is an aggregate; what reaches the driver is a bounded sample of documents over the kept features.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremill.llm.arrays import small_batches
from scoremill.llm.words import text_of
from scoremill.session import stage

SAMPLE = 4000  # labelled documents aimed at per label when learning: the documented bound of the sample
FEATURES = 200
UNEVEN = 3.5  # standard errors of the log odds ratio from 0
FOLDS = 5
RIDGE = 0.1
STEMS = (4, 6)  # lengths of word beginnings
THRESHOLD = 0.5
# Seed words of the categories before the last.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid"),
    "contempt": ("worthless", "pathetic", "disgusting", "scum", "trash"),
}
CATEGORIES = (*SEEDS, "toxic")
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """Words in lower case, and their beginnings marked by a trailing ``*``; whole text, each once."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in STEMS)) if words else words


@dataclass(frozen=True)
class Chain:
    """Place of each feature, and per category a weight for each feature and for each earlier category, and a bias."""

    places: dict[str, int]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category, each fed to the models after it."""
        out = np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.concatenate([x, out[:, :k]], 1) @ w[:-1] + w[-1])
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights and bias of a logistic regression with a ridge penalty, by Newton steps; the bias is not penalised."""
    design = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(design.shape[1])
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = math.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(design @ w)
        slope = design.T @ (p - y) + penalty * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        change = np.linalg.solve(bend, slope)
        w -= change
        if np.abs(change).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """A model per category, and the out-of-fold probabilities that later ones were trained with."""
    out_of_fold = np.zeros(labels.shape)
    weights = []
    for k in range(labels.shape[1]):
        fed = np.concatenate([x, out_of_fold[:, :k]], 1)
        for fold in np.unique(folds):
            out = folds == fold
            w = fit_linear(fed[~out], labels[~out, k]) if (~out).any() else np.zeros(fed.shape[1] + 1)
            out_of_fold[out, k] = _sigmoid(fed[out] @ w[:-1] + w[-1])
        weights.append(fit_linear(fed, labels[:, k]))
    return tuple(weights), out_of_fold


def _features(batches):
    for batch in batches:
        found = [sorted(features_of(t or "")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))],
            ["doc_id", "toxic", "features"],
        )


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Chain from the documents (doc_id, text) that labels (doc_id, toxic) covers.

    About ``sample`` documents per label are drawn by a hash of their id, whole texts each. Labels other than 0 and 1,
    null ids and null texts teach nothing; of several labels of a document the largest counts. Without a document of
    either label the chain has no features and predicts the share of toxic ones.
    """
    small_batches(docs)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = 1_000_000
    limit = F.lit(0)
    for label, n in sorted(sizes.items()):
        limit = F.when(F.col("toxic") == label, F.lit(int(parts * min(1.0, sample / n)))).otherwise(limit)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(parts)) < limit)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(drawn, "doc_id")
    # rows that repeat an id count once
    once = Window.partitionBy("doc_id").orderBy("text")
    texts = texts.withColumn("no", F.row_number().over(once)).where("no = 1").select("doc_id", "toxic", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(texts.mapInArrow(_features, f"doc_id {kind}, toxic int, features array<string>"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_yes, n_no = totals.get(1, 0), totals.get(0, 0)

    counted = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    counted = counted.agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")).where("yes + no >= 3")
    yes, no = F.col("yes") + 0.5, F.col("no") + 0.5
    ratio = F.log(yes / (n_yes - F.col("yes") + 0.5)) - F.log(no / (n_no - F.col("no") + 0.5))
    error = F.sqrt(1 / yes + 1 / (n_yes - F.col("yes") + 0.5) + 1 / no + 1 / (n_no - F.col("no") + 0.5))
    spread = counted.withColumn("spread", F.abs(ratio) / error).where(F.col("spread") >= UNEVEN)
    top = spread.orderBy(F.col("spread").desc(), "feature").limit(FEATURES)  # the number of features of the model
    places = {r["feature"]: i for i, r in enumerate(top.select("feature").collect())}

    chosen = F.array(*[F.lit(f) for f in sorted(places)]).cast("array<string>")
    seeds = {c: F.array(*[F.lit(w) for w in words]) for c, words in SEEDS.items()}
    sampled = rows.select(
        "toxic",
        _fold(F.col("doc_id")).alias("fold"),
        F.array_intersect("features", chosen).alias("kept"),
        *[F.arrays_overlap("features", words).cast("int").alias(c) for c, words in seeds.items()],
    ).collect()
    x = np.zeros((len(sampled), len(places)))
    for i, r in enumerate(sampled):
        x[i, [places[f] for f in r["kept"]]] = 1
    if not sampled:
        return Chain(places, tuple(np.append(np.zeros(len(places) + k), -40.0) for k in range(len(CATEGORIES))))
    marks = np.array([[r["toxic"] * r[c] for c in SEEDS] + [r["toxic"]] for r in sampled], float)
    weights, _ = fit_chain(x, marks, np.array([r["fold"] for r in sampled]))
    return Chain(places, weights)


def prediction(chain: Chain, text: Column | str = "text") -> Column:
    """Column struct of a probability per category for a text; null and empty texts have no features."""
    names = list(CATEGORIES)

    def predict(texts: pa.Array) -> pa.Array:
        x = np.zeros((len(texts), len(chain.places)))
        known = chain.places.keys()
        for i, t in enumerate(texts.to_pylist()):
            x[i, [chain.places[f] for f in features_of(t or "") & known]] = 1
        p = chain.probabilities(x)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names))], names)

    returned = "struct<" + ",".join(f"{n}:double" for n in names) + ">"
    return F.arrow_udf(predict, returned).asNondeterministic()(text_of(text))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability per category (p_insult, p_contempt, p_toxic), toxic_pred.

    Every whole text is scored by the chain learned from ``labels``; labels are no input of a prediction. Null and
    empty texts get the probabilities of a text without features. Repeated rows are scored alike, extra columns are
    ignored, an empty table gives an empty result.
    """
    chain = learn(docs, labels)
    scored = docs.select("doc_id", prediction(chain).alias("p"))
    return scored.select(
        "doc_id",
        *[F.col(f"p.{c}").alias(f"p_{c}") for c in CATEGORIES],
        (F.col("p.toxic") >= threshold).alias("toxic_pred"),
    )
