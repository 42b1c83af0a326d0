"""Experiments and their metric records: finding, fetching, listing, tagging, scoring.

``experiments(experiment_id, model_name, task_name, created, tags array<struct<key,value>>)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.functions import metrics as metric_fn
from scoremill.functions import names
from scoremill.functions import tags as tag_fn
from scoremill.operators.newest import newest

DASHBOARD = "dashboard"

def find_experiments(
    experiments: DataFrame,
    dashboard: str | None = None,
    model_name: str | None = None,
    limit: int | None = None,
    created_from: str | None = None,
) -> DataFrame:
    """Experiments of a dashboard, a model or both: all of them, unordered.

    With ``limit`` the newest so many, newest first; with ``created_from`` only those of that day or later.
    """
    if dashboard is None and model_name is None:
        raise ValueError("give a dashboard, a model name or both")
    found = experiments
    if created_from is not None:
        first_day = F.lit(created_from).cast(experiments.schema["created"].dataType)
        found = found.filter(F.col("created") >= first_day)
    if dashboard is not None:
        found = found.filter(tag_fn.has_tag(F.col("tags"), DASHBOARD, dashboard))
    if model_name is not None:
        found = found.filter(F.col("model_name") == model_name)
    if limit is None:
        return found
    return found.orderBy(F.desc("created"), "experiment_id").limit(limit)


def metrics_of(records: DataFrame, experiments: DataFrame) -> DataFrame:
    """Records of the given experiments, each once; no order. Spark picks the join by size."""
    return records.join(experiments.select("experiment_id"), "experiment_id", "left_semi")


def list_experiments(
    experiments: DataFrame, model_name: str, patterns: Sequence[str] = ()
) -> DataFrame:
    """``experiment_id, model_name, tasks, tags, n_tasks`` of one model.

    ``task_name`` is a comma list; only pieces that contain a match of any pattern are kept, and
    experiments left without a piece are dropped.
    """
    tasks = F.split("task_name", ",")
    if patterns:
        def wanted(piece: Column) -> Column:
            hit = F.lit(False)
            for pattern in patterns:
                hit = hit | piece.rlike(pattern)
            return hit

        tasks = F.filter(tasks, wanted)
    return (
        experiments.filter(F.col("model_name") == model_name)
        .select(
            "experiment_id", "model_name", tasks.alias("tasks"), tag_fn.render_tags(F.col("tags")).alias("tags")
        )
        .filter(F.size("tasks") > 0)
        .withColumn("n_tasks", F.size("tasks"))
    )


def add_to_dashboard(
    experiments: DataFrame,
    model_name: str,
    dashboard: str,
    source_dashboard: str | None = None,
    fuzzy: bool = False,
) -> DataFrame:
    """All experiments with ``changed``: the tag is merged into those of the model that lack it.

    With ``source_dashboard`` only experiments of that dashboard change. ``fuzzy`` takes every
    model whose name contains the given one.
    """
    hit = _model_test(model_name, fuzzy) & ~tag_fn.has_tag(F.col("tags"), DASHBOARD, dashboard)
    if source_dashboard is not None:
        hit = hit & tag_fn.has_tag(F.col("tags"), DASHBOARD, source_dashboard)
    return _retag(experiments, hit, tag_fn.with_tag(F.col("tags"), DASHBOARD, dashboard))


def remove_from_dashboard(
    experiments: DataFrame, model_name: str, dashboard: str, fuzzy: bool = False
) -> DataFrame:
    """All experiments with ``changed``: the dashboard's tag is taken off those of the model.

    The caller evicts changed experiments from the landing table.
    """
    hit = _model_test(model_name, fuzzy) & tag_fn.has_tag(F.col("tags"), DASHBOARD, dashboard)
    return _retag(experiments, hit, tag_fn.without_tag(F.col("tags"), DASHBOARD, dashboard))


def describe_records(records: DataFrame) -> DataFrame:
    """Add ``model``, ``alias``, ``is_aggregate`` and ``ts`` to metric records.

    Reads the JSON texts ``task_config`` and ``model_config``, ``task_name`` and the text
    ``current_date``, which may end in `` UTC``.
    """
    parsed = records.withColumns(
        {
            "_task": names.parse_task_config(F.col("task_config")),
            "_model": names.parse_model_config(F.col("model_config")),
        }
    )
    return parsed.withColumns(
        {
            "model": names.model_name(F.col("_model")),
            "alias": names.task_alias(F.col("_task"), F.col("task_config"), F.col("task_name")),
            "is_aggregate": names.is_aggregate(F.col("_task")),
            "ts": F.to_timestamp(F.regexp_replace("current_date", " UTC$", "+00:00")),
        }
    ).drop("_task", "_model")


def newest_records(described: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """Newest record per (model, alias). ``tiebreak`` columns make the order total, smallest first."""
    return newest(
        described, ["model", "alias"], [F.desc_nulls_last("ts"), *(F.asc(c) for c in tiebreak)]
    )


def record_cells(
    latest: DataFrame, tiebreak: Sequence[str], rules: Sequence[metric_fn.ScoreRule] = metric_fn.SCORE_RULES
) -> DataFrame:
    """Score table of the newest records, whose ``metrics`` text is parsed here.

    Aggregate records are skipped, a record without a model name fails the query, known bad scores
    are corrected, and derived columns are added. When a derived name is also a real task, the real
    task's score counts.
    """
    usable = metric_fn.with_metrics(latest.filter(~F.col("is_aggregate")))
    nameless = F.raise_error(F.lit("a metric record names no model")).cast("string")
    fixed = metric_fn.fix_scores(usable, rules).withColumn("model", F.coalesce("model", nameless))
    cells = fixed.select(
        "model",
        "ts",
        *tiebreak,
        F.explode(metric_fn.metric_cells(F.col("alias"), F.col("score"), F.col("metrics"))).alias("c"),
    ).select("model", "c.task", "c.score", "c.rank", "ts", *tiebreak)
    order = [F.asc("rank"), F.desc_nulls_last("ts"), *(F.asc(c) for c in tiebreak)]
    return newest(cells, ["model", "task"], order).select("model", "task", "score")


def _model_test(model_name: str, fuzzy: bool) -> Column:
    name = F.col("model_name")
    return name.contains(model_name) if fuzzy else name == model_name


def _retag(experiments: DataFrame, hit: Column, tags: Column) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    return experiments.withColumns({"changed": hit, "tags": F.when(hit, tags).otherwise(F.col("tags"))})
