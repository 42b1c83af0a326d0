"""Row and column order, row means, statistics and top-k of score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremill.operators import cells as cell_ops


def sort_rows(
    cells: DataFrame, by: str = "column", column: str | None = None, ascending: bool = True
) -> DataFrame:
    """Cells with a ``sort_key`` per model, ordered by it; ties are broken by model name, then task.

    ``column``: the score in ``column``, where null, absent and 0.0 sort as minus infinity; an
    unknown column raises, which is checked by a job. ``average``: the mean over all tasks with
    nulls as 0. ``name``: the model name. Keys are partial sums or maxima per model, joined back to
    the cells, so the table is read twice (three times for the average).
    """
    if by != "column" and column is not None:
        raise ValueError("a column only goes with by='column'")
    if by == "column":
        if column is None:
            raise ValueError("name the column to sort by")
        if not cell_ops.has_column(cells, column):
            raise ValueError(f"column {column!r} not found")
        wanted = F.when(F.col("task") == column, F.nullif(F.col("score"), F.lit(0.0)))
        key = F.coalesce(F.max(wanted), F.lit(float("-inf")))
    elif by == "average":
        key = F.coalesce(F.sum("score"), F.lit(0.0))
    elif by == "name":
        key = None
    else:
        raise ValueError(f"sort by column, average or name, not {by!r}")
    if key is None:
        keyed = cells.withColumn("sort_key", F.col("model"))
    else:
        keys = cells.groupBy(F.col("model").alias("_model")).agg(key.alias("sort_key"))
        if by == "average":
            keys = keys.withColumn("sort_key", F.col("sort_key") / _width(cells))
        keyed = cells.join(keys, F.col("model").eqNullSafe(F.col("_model"))).drop("_model")
    first = F.col("sort_key").asc() if ascending else F.col("sort_key").desc()
    return keyed.orderBy(first, "model", "task")


def row_means(cells: DataFrame) -> DataFrame:
    """``model, mean``: sum of the scores over **all** tasks of the table, nulls as 0."""
    total = F.coalesce(F.sum("score"), F.lit(0.0)).alias("_sum")
    return cells.groupBy("model").agg(total).select("model", (F.col("_sum") / _width(cells)).alias("mean"))


def _width(cells: DataFrame) -> Column:
    return cells.agg(F.count_distinct("task")).scalar()


def column_order(cells: DataFrame, arrival: str) -> DataFrame:
    """``task, pos``: tasks in the order their first cell arrived."""
    return cells.groupBy("task").agg(F.min(arrival).alias("pos"))


def row_order(cells: DataFrame, arrival: str) -> DataFrame:
    """``model, column_pos, pos``: models in the order a walk over the columns first meets them."""
    columns = column_order(cells, arrival).withColumnRenamed("pos", "column_pos")
    first = cells.groupBy("model", "task").agg(F.min(arrival).alias("_first"))
    seen = first.join(columns, "task").groupBy("model", "column_pos").agg(F.min("_first").alias("pos"))
    return seen.groupBy("model").agg(
        F.min("column_pos").alias("column_pos"), F.min_by("pos", "column_pos").alias("pos")
    )


def overlay_order(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column order of an overlay, as ``task, side, pos``: left columns, then the new right ones."""
    both = left.select("task", F.lit(0).alias("side"), "pos").unionByName(
        right.select("task", F.lit(1).alias("side"), "pos")
    )
    return both.groupBy("task").agg(F.min("side").alias("side"), F.min_by("pos", "side").alias("pos"))


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum per group."""
    return df.groupBy(group).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def top_k(df: DataFrame, group: Sequence[str] | str, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group in a total order, with their ``rank``.

    Catalyst keeps at most ``k`` rows per group and input task before the shuffle.
    """
    group = [group] if isinstance(group, str) else list(group)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
