"""Experiments and metric records from JSON lines.

Configurations stay raw JSON text, because the alias of a task may hash that text. Files read with
:func:`read_records` keep it character for character. :func:`parse_records`, for lines that are a
column already, gets nested texts from Spark's JSON functions, which drop blanks outside strings.
Metrics stay text too: they are parsed for the newest records only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremill.functions.tags import parse_tags

CORRUPT = "_corrupt"
EXPERIMENT_TYPE = "experiment_id string, model_name string, task_name string, created string, tags string"
RECORD_TYPE = (
    "experiment_id string, task_name string, task_idx int, task_hash string, task_config string, "
    "model_hash string, model_config string, compute_config string, current_date string, "
    f"num_instances int, processing_time double, metrics string, {CORRUPT} string"
)


def read_records(spark: SparkSession, path: str, skip_on_fail: bool = True) -> DataFrame:
    """Metric records of landed files (also gzip).

    ``skip_on_fail`` passes over files that cannot be read and marks lines that are no records
    (see :func:`accept` and :func:`count_dropped`); otherwise the first of either fails the query, and so
    does a line without a task name.
    """
    reader = spark.read.schema(RECORD_TYPE)
    for key, value in _modes(skip_on_fail).items():
        reader = reader.option(key, value)
    for key in ("ignoreCorruptFiles", "ignoreMissingFiles"):
        reader = reader.option(key, str(skip_on_fail).lower())
    return _marked(reader.json(path), skip_on_fail)


def parse_records(lines: DataFrame, skip_on_fail: bool = True) -> DataFrame:
    """Metric records of a column ``text``; other columns are kept.

    ``inline`` makes the fields columns of a generator, below which no filter on them is pushed, so
    each line is parsed once.
    """
    parsed = F.inline(F.array(F.from_json("text", RECORD_TYPE, _modes(skip_on_fail))))
    return _marked(lines.select(*(c for c in lines.columns if c != "text"), parsed), skip_on_fail)


def accept(records: DataFrame) -> DataFrame:
    """The records without malformed lines."""
    return records.filter(~F.col("malformed")).drop("malformed")


def count_dropped(records: DataFrame) -> DataFrame:
    """One row ``n_records, n_dropped``: what :func:`accept` keeps and drops."""
    return records.agg(
        F.count_if(~F.col("malformed")).alias("n_records"),
        F.count_if("malformed").alias("n_dropped"),
    )


def parse_experiments(lines: DataFrame) -> DataFrame:
    """``experiment_id, model_name, task_name, created, tags`` from a column ``text``.

    ``created`` is an instant; a text without an offset is read in the session's zone.
    """
    parsed = lines.select(F.from_json("text", EXPERIMENT_TYPE).alias("e")).select("e.*")
    return parsed.withColumns(
        {"created": F.col("created").cast("timestamp"), "tags": parse_tags(F.col("tags"))}
    )


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return parse_experiments(spark.read.text(path).select(F.col("value").alias("text")))


def _modes(skip_on_fail: bool) -> dict[str, str]:
    return {
        "mode": "PERMISSIVE" if skip_on_fail else "FAILFAST",
        "columnNameOfCorruptRecord": CORRUPT,
    }


def _marked(parsed: DataFrame, skip_on_fail: bool) -> DataFrame:
    # a record without a task is no record, however well its line parses
    bad = F.col(CORRUPT).isNotNull() | F.col("task_name").isNull()
    if not skip_on_fail:
        # tested in a filter too, so that no choice of columns takes the test away
        problem = F.raise_error(F.lit("a metric record names no task")).cast("boolean")
        bad = F.when(bad, problem).otherwise(False)
        parsed = parsed.filter(~bad)
    return parsed.withColumn("malformed", bad).drop(CORRUPT)
