"""Which (model, task) scores are missing, and the work that would fill them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremill.functions.patterns import Filter, compile_filters, matches_any
from scoremill.operators.suites import SuiteBook
from scoremill.session import local_table

# Tasks computed along with others, which are never launched on their own.
NOT_LAUNCHED = (r"^.*:pass_at_.*$",)
# Launch class by the first text a task name contains; the last class is the rest.
LAUNCH_CLASSES = ((":rc::", "rc"), (":mc::", "mc"), ("fim_", "fim"))
OTHER_CLASS = "gen"


def missing_columns(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``model, task`` of the columns a model has no score for, absent or null alike.

    One partial aggregation by model over the present names; only missing pairs are emitted.
    """
    columns = list(dict.fromkeys(columns))
    names = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    seen = F.col("score").isNotNull() & F.col("task").isin(*columns) if columns else F.lit(False)
    present = F.collect_set(F.when(seen, F.col("task")))
    return results.groupBy("model").agg(present.alias("_present")).select(
        "model", F.explode(F.array_except(names, "_present")).alias("task")
    )


def missing_tasks(
    results: DataFrame, columns: Sequence[str], book: SuiteBook, scope: str = "suite"
) -> DataFrame:
    """``model, column, task``: missing columns with suites expanded to leaf tasks.

    ``scope='suite'`` lists all leaves of a null suite column, also those that have scores;
    ``scope='leaf'`` lists only leaves without a score in ``results``.
    """
    gaps = missing_columns(results, columns)
    rows = [
        (column, leaf)
        for column in dict.fromkeys(columns)
        for leaf in (book.leaves(column) if column in book.suites else (column,))
    ]
    leaves = local_table(results.sparkSession, rows, "column string, task string")
    listed = gaps.withColumnRenamed("task", "column").join(leaves, "column")
    if scope == "leaf":
        scored = results.filter(F.col("score").isNotNull()).select("model", "task")
        listed = listed.join(scored, ["model", "task"], "left_anti")
    elif scope != "suite":
        raise ValueError(f"scope is suite or leaf, not {scope!r}")
    return listed.select("model", "column", "task")


def requested_filters(tasks: Sequence[str], book: SuiteBook) -> list[Filter]:
    """Filters for the given texts plus all leaves of the suites they match."""
    compiled = compile_filters(tasks)
    leaves = [leaf for f in compiled for name in book.search(f) for leaf in book.leaves(name)]
    return compiled + list(dict.fromkeys(leaves))


def missing_report(
    missing: DataFrame, tasks: Sequence[str], book: SuiteBook, models: Sequence[str] = ()
) -> DataFrame:
    """``model, n_missing, tasks``: distinct missing tasks among those asked for.

    The list of a model is as long as the table is wide at most. Models without gaps do not appear.
    """
    wanted = missing.filter(matches_any("task", requested_filters(tasks, book)))
    if models:
        wanted = wanted.filter(matches_any("model", compile_filters(models)))
    return wanted.groupBy("model").agg(F.array_sort(F.collect_set("task")).alias("tasks")).select(
        "model", F.size("tasks").alias("n_missing"), "tasks"
    )


def launch_class(task: Column) -> Column:
    """Class of a task name; the first text that occurs decides."""
    found = [F.when(task.contains(text), F.lit(label)) for text, label in LAUNCH_CLASSES]
    return F.coalesce(*found, F.lit(OTHER_CLASS))


def work_list(
    missing: DataFrame, partition_size: int = 0, not_launched: Sequence[str] = NOT_LAUNCHED
) -> DataFrame:
    """``model, launch_class, chunk, task``: what to run, in chunks of ``partition_size``.

    Tasks are distinct and sorted within a model and class; size 0 makes one chunk. Tasks that
    match a pattern of ``not_launched`` are computed along with others and left out.
    """
    excluded = F.lit(False)
    for pattern in not_launched:
        excluded = excluded | F.col("task").rlike(pattern)
    todo = missing.filter(~excluded).select("model", "task").distinct()
    todo = todo.withColumn("launch_class", launch_class(F.col("task")))
    if partition_size > 0:
        window = Window.partitionBy("model", "launch_class").orderBy("task")
        chunk = F.floor((F.row_number().over(window) - 1) / partition_size).cast("int")
    else:
        chunk = F.lit(0)
    return todo.withColumn("chunk", chunk).select("model", "launch_class", "chunk", "task")


def list_suites(closure: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """``suite, task, matched, total`` of a closure table ``suite, task``.

    No filters list everything. A suite whose name matches is listed whole, any other suite only
    with the members that match, each once.
    """
    total = closure.groupBy("suite").agg(F.count(F.lit(1)).alias("total"))
    if filters:
        whole = matches_any("suite", filters)
        shown = closure.filter(whole | matches_any("task", filters))
    else:
        shown = closure
    matched = shown.groupBy("suite").agg(F.count(F.lit(1)).alias("matched"))
    return shown.join(matched.join(total, "suite"), "suite").select("suite", "task", "matched", "total")
