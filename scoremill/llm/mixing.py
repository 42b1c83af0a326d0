"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash of the document id. A document's virtual finish time is the number of
its source's words up to its end, divided by the source's target. Serving documents in the order of finish
time makes every source advance in proportion to its target; the queue ends where the total budget does.
A source may be served up to ``cap`` times; the second turn repeats the order of the first.

No step gathers a source: the running sum of a source is taken inside slices of the hash range, and slice
totals are added afterwards. The end of the queue is located in a histogram of finish times of fixed size;
only the slice of the histogram that holds it is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremill.llm.words import WORD, text_of
from scoremill.session import stage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
TURNS = 2
SLICE_ROWS = 2000  # documents aimed at in a slice of one source's hash range; changes no result
TICKS = 4096  # histogram cells per unit of finish time; changes no result


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, turns=TURNS) -> DataFrame:
    """One row per source: source, source_rank, source_size, target.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last, get the weights in turn.
    They share ``budget`` times all words; a target stops at ``turns`` times its source's words and the
    excess is shared again by weight. Solved at once: in the order of words per weight the sources that
    stop come first, so sums before and after each source decide. Sources without words get 0. The windows
    here see one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = (
        per_source.withColumn("source_rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("full", F.col("source_size") * turns)
        .withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)))
    )
    order = Window.orderBy("ratio", "source_rank")
    stopped = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", (F.col("budget") - stopped) / open_weight)
    # The first source whose fair share does not exceed what it has sets the level of all after it.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(
        Window.partitionBy()
    )
    share = F.least(F.col("full").cast("double"), F.coalesce(F.col("weight") * level["level"], F.col("full")))
    return leveled.select("source", "source_rank", "source_size", share.alias("target"))


def _slice_digits(rows: int) -> int:
    return max(1, math.ceil(math.log(max(rows, 1) / SLICE_ROWS + 1, 16)))


def queue(sizes: DataFrame, source_targets: DataFrame, seed: int, rows: int) -> DataFrame:
    """``sizes`` with the columns of ``targets`` and ``ends``, the words of its source up to its end.

    Slices of the hash range replace one long running sum per source.
    """
    digits = _slice_digits(rows)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sizes.withColumn("shuffle_key", key).withColumn("slice", F.substring("shuffle_key", 1, digits))
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .drop("words")
        .join(source_targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumnsRenamed({"source": "s_source", "slice": "s_slice"})
    )
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy("shuffle_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed.withColumn("inside", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
        .withColumn("ends", F.col("inside") + F.col("start"))
        .drop("inside", "start", "s_source", "s_slice", "slice", "shuffle_key")
    )


def _finish(turn: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("source_size") * turn + F.col("ends")) / F.col("target"))


def mix(
    docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, turns: int = TURNS, seed: int = 7
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies.

    ``docs`` needs doc_id, text and source; other columns are ignored. ``size`` counts words, 0 for a null
    or empty text. ``taken`` is ``size`` times ``copies``, the number of turns (0 to ``turns``) that the
    queue serves the document before the budget ends; documents are served whole. A null doc_id is
    shuffled as the text "null", a null source is a source of its own. Rows with the same doc_id are
    served one after the other, the shorter first. An empty table gives an empty result.
    """
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = float(words) * float(budget)
    served = stage(queue(sizes, targets(sizes, weights, budget, turns), seed, rows))
    entries = served.where("size > 0").select(
        "source_rank", "size", F.explode(F.array(*[_finish(t) for t in range(turns)])).alias("finish")
    )
    tick = F.least(F.floor(F.col("finish") * TICKS), F.lit(2 * TICKS)).alias("tick")
    served_words, cell = 0, None
    for tick_no, size in sorted(tuple(r) for r in entries.groupBy(tick).agg(F.sum("size")).collect()):
        if served_words + size > total:
            cell = tick_no
            break
        served_words += size
    if cell is None:
        last = (math.inf, 0)
    else:
        order = Window.orderBy("finish", "source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (
            entries.where(tick == cell)
            .withColumn("running", F.sum("size").over(order) + F.lit(served_words))
            .where(F.col("running") <= total)
            .agg(F.max(F.struct("finish", "source_rank")).alias("last"))
            .first()["last"]
        )
        last = tuple(found) if found else (cell / TICKS, -1)

    def in_time(turn: int) -> Column:
        finish = _finish(turn)
        by = (finish < last[0]) | ((finish == last[0]) & (F.col("source_rank") <= last[1]))
        return F.when((F.col("size") > 0) & by, 1).otherwise(0)

    copies = sum((in_time(t) for t in range(1, turns)), in_time(0))
    return served.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the queue serves it, with all its columns.

    Documents served no time go. Rows that share doc_id, source and size are told apart by the digest of
    their text.
    """
    taken = mix(docs, **options).select("doc_id", "source", "size", "copies")
    keys = ["mix_id", "mix_source", "mix_size"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("copies").desc()))
    right = taken.withColumnsRenamed({"doc_id": "mix_id", "source": "mix_source", "size": "mix_size"}).withColumn(
        "mix_no", number
    )
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"),
        F.col("doc_id").alias("d_id"),
        F.col("source").alias("d_source"),
        word_count(F.col("text")).alias("d_size"),
    )
    own = Window.partitionBy("d_id", "d_source", "d_size").orderBy(F.md5(text_of(F.col("mix_doc")["text"])))
    left = left.withColumn("d_no", F.row_number().over(own))
    same = (
        F.col("d_id").eqNullSafe(F.col("mix_id"))
        & F.col("d_source").eqNullSafe(F.col("mix_source"))
        & (F.col("d_size") == F.col("mix_size"))
        & (F.col("d_no") == F.col("mix_no"))
    )
    return (
        left.join(right.where("copies > 0"), same)
        .withColumn("mix_turn", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("mix_doc.*")
    )
