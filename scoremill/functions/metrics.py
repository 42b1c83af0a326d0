"""Fields of one metric record."""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.functions import names

# Metric fields shared by all tasks; every other key is an extra metric.
SHARED_FIELDS = ("primary_score", "logits_per_byte_corr", "bits_per_byte_corr")
# The k of the pass-at-k metrics that get a column.
PASS_AT = (4, 16)

METRICS_TYPE = (
    "struct<primary_score:double,logits_per_byte_corr:double,bits_per_byte_corr:double,"
    "extra_metrics:map<string,double>>"
)


@dataclass(frozen=True)
class ScoreRule:
    """Correction of the primary score of tasks whose alias contains all ``contains`` texts.

    Actions: ``extra`` takes the extra metric ``arg``, ``divide`` divides by ``arg``, ``unhash``
    drops the last ``-`` and what follows from an alias listed in ``contains``.
    """

    contains: tuple[str, ...]
    action: str
    arg: str | float | None = None


# The known corrections, in the order they apply. A caller adds the rules of its own tasks.
SCORE_RULES = (
    ScoreRule(("alpaca",), "divide", 100.0),
    ScoreRule(("styled_math500", "tulu"), "extra", "exact_match_flex"),
    ScoreRule(("wildchat_masked_ppl-67b0e9", "ultrachat_masked_ppl-831470"), "unhash"),
)


def with_metrics(records: DataFrame, text: str = "metrics") -> DataFrame:
    """Turn a column of JSON text into the metrics struct; null where the text is no object.

    Keys that are not shared join ``extra_metrics`` and win over nested keys of the same name. A
    missing primary score is null. The text is parsed once, in a projection of its own.
    """
    top = F.col("_top")
    shared = [F.try_element_at(top, F.lit(name)).try_cast("double").alias(name) for name in SHARED_FIELDS]
    nested = F.from_json(F.try_element_at(top, F.lit("extra_metrics")), "map<string,double>")
    loose = F.transform_values(
        F.map_filter(top, lambda k, _: ~k.isin(*SHARED_FIELDS, "extra_metrics")),
        lambda _, v: v.try_cast("double"),
    )
    kept = F.map_filter(F.col("_nested"), lambda k, _: ~F.map_contains_key(F.col("_loose"), k))
    extra = F.coalesce(F.map_concat(kept, "_loose"), F.col("_loose"))
    fields = [F.col(f"_shared.{name}").alias(name) for name in SHARED_FIELDS]
    return (
        records.withColumn("_top", F.from_json(text, "map<string,string>"))
        .withColumns({"_shared": F.struct(*shared), "_nested": nested, "_loose": loose})
        .withColumn(text, F.when(top.isNotNull(), F.struct(*fields, extra.alias("extra_metrics"))))
        .drop("_top", "_shared", "_nested", "_loose")
    )


def bits_per_byte(metrics: Column) -> Column:
    """Bits per byte, else logits per byte; a zero counts as not given."""
    return F.coalesce(
        F.nullif(metrics["bits_per_byte_corr"], F.lit(0.0)), metrics["logits_per_byte_corr"]
    )


def extra_metric(metrics: Column, name: str) -> Column:
    return F.try_element_at(metrics["extra_metrics"], F.lit(name))


def pass_at(metrics: Column, k: int) -> Column:
    return extra_metric(metrics, f"pass_at_{k}")


def fix_scores(records: DataFrame, rules: Sequence[ScoreRule] = SCORE_RULES) -> DataFrame:
    """Apply the rules to ``alias`` and ``metrics``; adds ``score`` and ``fix_missing``.

    ``fix_missing`` marks records whose rule asked for an extra metric they do not have: their
    score is null, and the mark lets a caller count or refuse them.
    """
    alias, metrics = F.col("alias"), F.col("metrics")
    score, missing, renamed = metrics["primary_score"], F.lit(False), alias
    for rule in rules:
        if rule.action == "unhash":
            renamed = F.when(
                alias.isin(*rule.contains), F.regexp_replace(alias, "-[^-]*$", "")
            ).otherwise(renamed)
            continue
        hit = F.lit(True)
        for text in rule.contains:
            hit = hit & alias.contains(text)
        if rule.action == "extra":
            value = extra_metric(metrics, rule.arg)
            missing = missing | (hit & value.isNull())
        elif rule.action == "divide":
            value = score / F.lit(rule.arg)
        else:
            raise ValueError(f"unknown action {rule.action!r}")
        score = F.when(hit, value).otherwise(score)
    return records.withColumns({"score": score, "fix_missing": missing, "alias": renamed})


def metric_cells(alias: Column, score: Column, metrics: Column) -> Column:
    """Array of the cells of one record: ``struct<task,score,rank>``.

    The primary score (rank 0) is always there, even when null. Bits per byte (1) and pass-at-k
    (2, 3) only when they have a value, and bits per byte only when the task may have that column.
    """
    def cell(task: Column, value: Column, rank: int) -> Column:
        return F.struct(
            task.alias("task"), value.cast("double").alias("score"), F.lit(rank).alias("rank")
        )

    derived = [cell(names.bpb_name(alias), bits_per_byte(metrics), 1)]
    derived += [
        cell(names.pass_at_name(alias, k), pass_at(metrics, k), 2 + i) for i, k in enumerate(PASS_AT)
    ]
    kept = F.filter(F.array(*derived), lambda c: c["task"].isNotNull() & c["score"].isNotNull())
    return F.concat(F.array(cell(alias, score, 0)), kept)
