"""Score tables as long frames ``cells(model, task, score)``.

A stored null (a row whose score is null) and an absent cell (no row) are different things:
``drop_empty`` and ``shape`` see stored cells only, averages and missing reports see both alike.
A (model, task) pair has at most one row.

Operators that look at a table twice say so; give them a staged table (``session.stage``) rather
than the whole computation behind it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremill.functions.patterns import Filter, matches_any
from scoremill.session import local_table

CELL_TYPE = "model string, task string, score double"
KEY = ("model", "task")


def make_cells(df: DataFrame, triples: Iterable[tuple[str, str, float | None]]) -> DataFrame:
    """A table of literal ``(model, task, score)`` cells; the last of a repeated pair counts."""
    last = {(model, task): score for model, task, score in triples}
    rows = [(model, task, None if score is None else float(score)) for (model, task), score in last.items()]
    return local_table(df.sparkSession, rows, CELL_TYPE)


def keep_columns(cells: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Cells of tasks that any filter matches; no filters keep nothing."""
    return cells.filter(matches_any("task", filters))


def drop_columns(cells: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Cells of tasks that no filter matches; no filters keep everything."""
    return cells.filter(~matches_any("task", filters))


def keep_rows(cells: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return cells.filter(matches_any("model", filters))


def drop_rows(cells: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return cells.filter(~matches_any("model", filters))


def drop_empty(cells: DataFrame) -> DataFrame:
    """Drop every task that has a stored null. Reads the table twice."""
    empty = cells.filter(F.col("score").isNull()).select("task").distinct()
    return cells.join(empty, "task", "left_anti").select(cells.columns)


def keep_matching_tasks(cells: DataFrame, patterns: DataFrame) -> DataFrame:
    """Cells of tasks that match any row of ``patterns(pattern)``. Reads the table twice.

    The patterns meet the distinct task names, never the cells. They are dealt to as many chunks as
    the session has shuffle partitions, and each name visits every chunk, so the tests spread evenly
    and no task holds all patterns; a task that several patterns match keeps its cells once.
    """
    chunks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("pattern"), F.lit(chunks)).cast("int")
    dealt = patterns.distinct().select("pattern", chunk.alias("chunk"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    tasks = cells.select("task").distinct().select("task", every.alias("chunk"))
    hit = (tasks["chunk"] == dealt["chunk"]) & F.rlike(tasks["task"], dealt["pattern"])
    wanted = tasks.join(dealt, hit, "left_semi").select("task").distinct()
    return cells.join(wanted, "task", "left_semi").select(cells.columns)


def overlay(left: DataFrame, right: DataFrame) -> DataFrame:
    """All cells of both tables; where both store a cell the right one wins, even when it is null."""
    both = _ranked(left, 0).unionByName(_ranked(right, 1))
    return both.groupBy(*KEY).agg(F.max_by("score", "_rank").alias("score"))


def overlay_all(start: DataFrame, *tables: DataFrame) -> DataFrame:
    """Fold of :func:`overlay` over any number of tables in one aggregation."""
    both = _ranked(start, 0)
    for rank, table in enumerate(tables, 1):
        both = both.unionByName(_ranked(table, rank))
    return both.groupBy(*KEY).agg(F.max_by("score", "_rank").alias("score"))


def fill(cells: DataFrame, extra: DataFrame) -> DataFrame:
    """Add ``extra`` without overwriting: it only fills cells that are absent or null."""
    mine = cells.select(*KEY, "score", F.when(F.col("score").isNull(), 0).otherwise(2).alias("_rank"))
    both = mine.unionByName(_ranked(extra, 1))
    return both.groupBy(*KEY).agg(F.max_by("score", "_rank").alias("score"))


def put(cells: DataFrame, *triples: tuple[str, str, float | None], overwrite: bool = True) -> DataFrame:
    """Set a few cells."""
    extra = make_cells(cells, triples)
    return overlay(cells, extra) if overwrite else fill(cells, extra)


def get(cells: DataFrame, task: str, model: str) -> float | None:
    """One score; an unknown task raises, an unknown model gives None. Runs a job."""
    found = (
        cells.filter(F.col("task") == task)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("model") == model, F.col("score"))).alias("score"),
        )
        .first()
    )
    if found["n"] == 0:
        raise KeyError(task)
    return found["score"]


def has_column(cells: DataFrame, task: str) -> bool:
    """Runs a job."""
    return not cells.filter(F.col("task") == task).isEmpty()


def densify(cells: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """The cells of ``tasks`` for every model of ``cells``, null where there is none.

    One pass: a model's stored cells come together in one row, which is as long as the task list at
    most, and the names it lacks are added there.
    """
    tasks = list(dict.fromkeys(tasks))
    if not tasks:
        return cells.limit(0)
    stored = F.collect_list(F.when(F.col("task").isin(*tasks), F.struct("task", "score")))
    names = F.array(*map(F.lit, tasks))
    blank = F.transform(
        F.array_except(names, F.transform("stored", lambda c: c["task"])),
        lambda name: F.struct(name.alias("task"), F.lit(None).cast("double").alias("score")),
    )
    return (
        cells.groupBy("model")
        .agg(stored.alias("stored"))
        .select("model", F.explode(F.concat("stored", blank)).alias("c"))
        .select("model", "c.task", "c.score")
    )


def missing_per_row(cells: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``model, missing``: the table's tasks that a model has no score for, sorted.

    Counts absent cells and stored nulls. Lists are as long as the table is wide at most. Without
    ``columns`` the task names are read from the table, which costs a second pass over it.
    """
    if columns is None:
        names = cells.agg(F.array_sort(F.collect_set("task"))).scalar()
    else:
        names = F.array(*map(F.lit, sorted(set(columns))))
    present = F.collect_set(F.when(F.col("score").isNotNull(), F.col("task")))
    return cells.groupBy("model").agg(present.alias("_present")).select(
        "model", F.array_except(names, "_present").alias("missing")
    )


def shape(cells: DataFrame) -> DataFrame:
    """One row ``n_columns, n_rows``: tasks, and the stored cells of the longest task."""
    return (
        cells.groupBy("task")
        .count()
        .agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.coalesce(F.max("count"), F.lit(0).cast("bigint")).alias("n_rows"),
        )
    )


def column_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Task names of the left table only."""
    return left.select("task").distinct().join(right.select("task"), "task", "left_anti")


def column_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Task names of both tables."""
    return left.select("task").distinct().join(right.select("task"), "task", "left_semi")


def column_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct task names of either table."""
    return left.select("task").unionByName(right.select("task")).distinct()


def append_new_columns(cells: DataFrame, extra: DataFrame) -> DataFrame:
    """Add the tasks of ``extra`` that ``cells`` does not have yet. Reads ``cells`` twice."""
    new = extra.join(cells.select("task").distinct(), "task", "left_anti")
    return cells.select(*KEY, "score").unionByName(new.select(*KEY, "score"))


def _ranked(cells: DataFrame, rank: int) -> DataFrame:
    return cells.select(*KEY, "score", F.lit(rank).alias("_rank"))
