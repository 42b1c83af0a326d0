"""Rules that give documents a reason to go, and the best share of every source by a score.

The cut of a source is found by refining histograms: a round counts the undecided rows of every source in up to 256
bins between their smallest and largest score, and the bin that holds the cut is refined by the next one. No source is
sorted or gathered, and a hot one sends no more rows than others, as counts are added up before the shuffle. Scores
that tie at the cut are decided by id in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from scoremill.session import stage

BINS = 256
Rule = tuple[str, Column | str]


def with_reason(docs: DataFrame, rules: Sequence[Rule], column: str = "reason") -> DataFrame:
    """``docs`` with the name of the first rule whose condition holds; null for a document that no rule meets.

    A rule is a name and a condition, as a column or in SQL. A condition that is null for a row does not hold.
    """
    names = [name for name, _ in rules]
    if len(set(names)) < len(names):
        raise ValueError("rules need names of their own")
    conditions = [(name, F.expr(c) if isinstance(c, str) else c) for name, c in rules]
    return docs.withColumn(column, F.coalesce(*(F.when(c, F.lit(name)) for name, c in conditions), F.lit(None).cast("string")))


def counted(reasons: DataFrame, rules: Sequence[Rule], column: str = "reason") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that any action on them fills: documents by reason, and ``kept``."""
    watch = Observation()
    sums = [F.count_if(F.col(column) == name).alias(name) for name, _ in rules if name != "kept"]
    return reasons.observe(watch, F.count_if(F.col(column).isNull()).alias("kept"), *sums), watch


def _narrowed(undecided: DataFrame, bin_of: Column, value: str) -> DataFrame:
    """The bin with the cut by source: its range, how many rows it has, and how many of them stay."""
    bins = undecided.groupBy("source", "need", bin_of.alias("bin")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    placed = bins.withColumn("before", F.coalesce(before, F.lit(0)))  # at most BINS rows of a source
    here = (F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("n"))
    return placed.where(here).select("source", "low", "high", "n", (F.col("need") - F.col("before")).alias("need"))


def _refine(rows: DataFrame, value: str, state: DataFrame, bin_of: Column) -> DataFrame:
    """The state of every source when its bin is one value, or stays as a whole."""
    while True:
        state = stage(state)
        if state.where("low < high AND need < n").isEmpty():
            return state
        open_ = state.where("low < high AND need < n").withColumnRenamed("source", "_source")
        inside = rows.join(open_, F.col("source").eqNullSafe(F.col("_source")) & F.col(value).between(F.col("low"), F.col("high")))
        state = state.where("low = high OR need = n").unionByName(_narrowed(inside.drop("n"), bin_of, value))


def best_share(rows: DataFrame, share: float, source: str = "source", score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """``rows`` in the best ``share`` of their source by score, the largest first and ties by the smaller id.

    Of n rows with a score ``ceil(share * n)`` stay. A null or non-finite score or a null id has no rank, and its row
    goes. Rows equal in score and id stay or go together. A null source is a source.
    """
    if not 0 <= share <= 1:
        raise ValueError("share is between 0 and 1")
    finite = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.abs(F.col(score).cast("double")) < float("inf"))
    named = rows.select(
        F.col(source).alias("source"),
        (-F.col(score).cast("double")).alias("v"),
        F.col(doc_id).cast("decimal(20,0)").alias("id"),
    ).where(finite & F.col("id").isNotNull())
    ranked = stage(named)
    state = ranked.groupBy("source").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = state.withColumn("need", F.ceil(F.col("n") * F.lit(share))).where("need > 0")
    # halves, as the difference of two large scores may overflow
    place = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    state = _refine(ranked, "v", state, F.least(F.floor(place * BINS), F.lit(BINS - 1)))
    by_score = state.select("source", F.col("high").alias("cut"), "need", "n")
    # of the scores at the cut only some stay: the smallest ids
    ties = by_score.where("need < n")
    at_cut = ranked.join(ties.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("v") == F.col("cut")))
    at_cut = stage(at_cut.select("source", "id", "need"))
    ids = at_cut.groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("need").alias("need"))
    step = F.expr(f"floor((high - low) / {BINS}) + 1")
    last = _refine(at_cut.drop("need"), "id", ids, F.floor((F.col("id") - F.col("low")) / step))
    cuts = by_score.join(last.select(F.col("source").alias("_s"), F.col("high").alias("last")), F.col("source").eqNullSafe(F.col("_s")), "left")
    cuts = cuts.select(F.col("source").alias("_source"), "cut", "last")
    value, own = -F.col(score).cast("double"), F.col(doc_id).cast("decimal(20,0)")
    stays = (value < F.col("cut")) | ((value == F.col("cut")) & own.isNotNull() & (F.col("last").isNull() | (own <= F.col("last"))))
    joined = rows.join(cuts, F.col(source).eqNullSafe(F.col("_source")))
    return joined.where(finite & own.isNotNull() & stays).select(*(rows[c] for c in rows.columns))


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, first_id, copies) for every row: the smallest id with the same text, and how many rows have it.

    Texts are compared by a 256-bit digest, counted before the shuffle, so a text of a third of all rows is one row per
    task. A null text is a text of its own; null ids are never the smallest unless there is no other.
    """
    digest = F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"))
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return rows.join(texts, "digest").select("doc_id", "first_id", "copies")
