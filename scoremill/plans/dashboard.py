"""The dashboard query: records to score table to suites to report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremill.functions import metrics as metric_fn
from scoremill.functions.patterns import compile_filters, matches_any
from scoremill.operators import cells as cell_ops
from scoremill.operators import coverage
from scoremill.operators import experiments as exp
from scoremill.operators.suites import SuiteBook, combine, score_columns
from scoremill.sources import export, landing

TIEBREAK = ("experiment_id", "task_idx")


def dashboard_cells(
    experiments: DataFrame,
    records: DataFrame,
    dashboard: str,
    limit: int | None = None,
    created_from: str | None = None,
    rules: Sequence[metric_fn.ScoreRule] = metric_fn.SCORE_RULES,
) -> DataFrame:
    """Score table of a dashboard: its experiments, their newest records, corrected by ``rules`` and derived."""
    found = exp.find_experiments(experiments, dashboard, limit=limit, created_from=created_from)
    described = exp.describe_records(exp.metrics_of(records, found))
    return exp.record_cells(exp.newest_records(described, TIEBREAK), TIEBREAK, rules)


def results(
    cells: DataFrame,
    tasks: Sequence[str],
    book: SuiteBook,
    models: Sequence[str] = (),
    view_in_view_is_null: bool = True,
) -> DataFrame:
    """Selected tasks and combined suites of a score table, in long form.

    ``tasks`` are names or patterns, of tasks and of suites. Suites combine over all tasks of the
    table, not only the selected ones, and are dense over its models; single tasks keep their
    stored cells, which win over a suite's column of the same name. Everything built in is one pass
    over ``cells``. Suites of a custom kind are combined by their own function and laid under.
    """
    filters = compile_filters(tasks)
    columns: dict = {}
    listed: list[str] = []
    custom: list[DataFrame] = []
    for name in _matched(filters, book):
        kind = book.get(name).kind
        if kind in book.combiners:
            frame = combine(cells, book, name)
            if frame is None:
                listed += book.leaves(name)
            else:
                custom.append(frame)
        elif kind == "LIST":
            listed += book.leaves(name)
        else:
            columns.update(book.columns(name, view_in_view_is_null))
    if models:
        cells = cell_ops.keep_rows(cells, compile_filters(models))
        custom = [cell_ops.keep_rows(frame, compile_filters(models)) for frame in custom]
    direct = matches_any("task", [*filters, *dict.fromkeys(listed)])
    scored = score_columns(cells, columns, direct) if columns else cells.filter(direct)
    if custom:
        return cell_ops.overlay_all(*reversed(custom), scored)
    return scored.select("model", "task", "score")


def result_columns(
    cells: DataFrame, tasks: Sequence[str], book: SuiteBook, view_in_view_is_null: bool = True
) -> list[str]:
    """Column names of :func:`results` in display order.

    Suites that match later stand further in front, list members at the back; single tasks are in
    name order. The distinct task names of the selection come to the driver: they are the header.
    """
    filters = compile_filters(tasks)
    order = _task_names(cell_ops.keep_columns(cells, filters))
    for name in _matched(filters, book):
        kind = book.get(name).kind
        frame = combine(cells, book, name) if kind in book.combiners else None
        if frame is not None:
            front = _task_names(frame)
        elif kind == "LIST" or kind in book.combiners:
            new = cell_ops.keep_columns(cells, [t for t in book.leaves(name) if t not in order])
            order = order + _task_names(new)
            continue
        else:
            front = list(book.columns(name, view_in_view_is_null))
        order = front + [c for c in order if c not in front]
    return order


def report(
    cells: DataFrame,
    tasks: Sequence[str],
    book: SuiteBook,
    models: Sequence[str] = (),
    by: str | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Wide results, a row per model, ordered by one column (the first by default), best first.

    With ``models`` the header holds what those models have. Reads ``cells`` twice: once for the header, once
    for the scores.
    """
    mine = cell_ops.keep_rows(cells, compile_filters(models)) if models else cells
    columns = result_columns(mine, tasks, book)
    if not columns:
        return cells.select("model").limit(0)
    return export.wide_sorted(results(cells, tasks, book, models), columns, by or columns[0], ascending)


def evict_changed(tagged: DataFrame, table: str) -> None:
    """Evict the experiments whose tags changed from the landing table, so they are fetched again."""
    landing.evict(tagged.sparkSession, table, tagged.filter("changed"))


def backfill(
    cells: DataFrame,
    model: str,
    tasks: Sequence[str],
    book: SuiteBook,
    columns: Sequence[str],
    partition_size: int = 0,
    not_launched: Sequence[str] = coverage.NOT_LAUNCHED,
) -> DataFrame:
    """Work list of the scores that one model lacks among the result columns.

    The model name selects by exact name, although a name with a hyphen would match more as a pattern.
    """
    mine = results(cells, tasks, book, [model]).filter(F.col("model") == model)
    return coverage.work_list(coverage.missing_tasks(mine, columns, book), partition_size, not_launched)


def _matched(filters, book: SuiteBook) -> list[str]:
    return list(dict.fromkeys(name for f in filters for name in book.search(f)))


def _task_names(cells: DataFrame) -> list[str]:
    return [row["task"] for row in cells.select("task").distinct().orderBy("task").collect()]
