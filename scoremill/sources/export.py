"""Sinks for score tables: JSON, CSV and the console."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.functions.display import percent_text
from scoremill.session import stage


def wide(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per model, a column per task in the given order. Naming them saves a job."""
    return cells.groupBy("model").pivot("task", list(columns)).agg(F.first("score"))


def wide_sorted(cells: DataFrame, columns: Sequence[str], by: str, ascending: bool = False) -> DataFrame:
    """Wide table ordered by one column, null and 0.0 as minus infinity, ties by model name.

    The default is descending.
    """
    key = F.coalesce(F.nullif(F.col(f"`{by}`"), F.lit(0.0)), F.lit(float("-inf")))
    return wide(cells, columns).orderBy(key.asc() if ascending else key.desc(), "model")


def percent_table(table: DataFrame, name: str = "name") -> DataFrame:
    """Wide table with scores as percentage text and the model under ``name``."""
    scores = [c for c in table.columns if c != "model"]
    return table.select(
        F.col("model").alias(name), *(percent_text(F.col(f"`{c}`")).alias(c) for c in scores)
    )


def write_csv(table: DataFrame, path: str) -> None:
    """Header ``name`` and the columns in table order; scores as percentages, quoted where needed."""
    percent_table(table).write.mode("overwrite").option("header", "true").csv(path)


def show(table: DataFrame, n: int | None = None) -> None:
    """Print the table as percentages, all rows or the first ``n``. Without ``n`` the rows are counted first."""
    percent_table(table, " ").show(table.count() if n is None else n, truncate=False)


def json_lines(cells: DataFrame) -> DataFrame:
    """``task, model, line``: the pieces of one JSON document ``{task: {model: score}}``.

    Ordered by task, then model, and joined, the lines are the document, with sorted keys, raw
    fractions and nulls. Each cell knows from its task's first and last model, and from the first
    and last task, which brackets to add, so no task's cells ever come together in one row. Reads
    the table three times.
    """
    ends = cells.groupBy("task").agg(F.min("model").alias("_first"), F.max("model").alias("_last"))
    bounds = ends.agg(F.struct(F.min("task").alias("first"), F.max("task").alias("last"))).scalar()
    opens, closes = F.col("model") == F.col("_first"), F.col("model") == F.col("_last")
    starts, finishes = F.col("task") == bounds["first"], F.col("task") == bounds["last"]
    line = F.concat(
        F.when(opens & starts, "{").otherwise(""),
        F.when(opens, F.concat(_json_text("task"), F.lit(": {"))).otherwise(""),
        _json_text("model"),
        F.lit(": "),
        F.coalesce(F.col("score").cast("string"), F.lit("null")),
        F.when(closes & finishes, "}}").when(closes, "},").otherwise(","),
    )
    return cells.join(ends, "task").select("task", "model", line.alias("line"))


def write_json(cells: DataFrame, path: str) -> None:
    """The document of :func:`json_lines` as text files; read in name order they are the document."""
    json_lines(stage(cells)).orderBy("task", "model").select("line").write.mode("overwrite").text(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Long form, one JSON object per cell, with explicit nulls."""
    cells.select("model", "task", "score").write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def write_domains(rows: DataFrame, domain: str, path: str) -> None:
    """Rows in one folder per domain, as Parquet; ``spark.read.parquet(path)`` has the domain as a column again.

    Rows of a domain come together for few files, and Spark splits a domain that is much larger than others.
    """
    rows.hint("rebalance", domain).write.mode("overwrite").partitionBy(domain).parquet(path)


def _json_text(name: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r'^\{"v":(.*)\}$', 1)
