"""Path lists of data configurations: counts per folder and configuration differences.

``paths(config, path)`` has one row per listed file; ``settings(config, key, value)`` one row per
flattened key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremill.functions import paths as path_fn
from scoremill.session import stage

# Keys that the differences of many configurations leave out.
PATH_KEY = "data.paths"
DATA_KEY = "data"
MIXTURE_KEY = "dataset.source_mixture_config.source_configs"
DATASET_PATH_KEY = "dataset.paths"
MISSING = "-"
TOTAL = "Total"


def token_files(paths: DataFrame) -> DataFrame:
    """Listed paths that name token arrays."""
    return paths.filter(F.col("path").endswith(".npy"))


def path_counts(paths: DataFrame) -> DataFrame:
    """``config, base_path, n``: listed files per group of paths."""
    normal = paths.select("config", path_fn.storage_path(F.col("path")).alias("_path"))
    based = normal.select("config", path_fn.base_path(F.col("_path")).alias("base_path"))
    return based.groupBy("config", "base_path").agg(F.count(F.lit(1)).alias("n"))


def path_table(counts: DataFrame, configs: Sequence[str] | None = None) -> DataFrame:
    """One row per base path and a ``Total`` row last; a column per configuration.

    Columns go from the largest total down, rows by the counts in the two largest. ``match`` says
    that all non-zero counts are equal; a zero prints as null. ``configs`` selects configurations; one
    without paths is a column of nulls, last. The counts are staged, and the totals of the configurations
    (one row each) come to the driver, because they name and order the columns.
    """
    if configs is not None:
        counts = counts.filter(F.col("config").isin(*configs))
    counts = stage(counts)
    totals = counts.groupBy("config").agg(F.sum("n").alias("n"))
    largest = [r["config"] for r in totals.orderBy(F.desc("n"), "config").collect()]
    largest += sorted(set(configs or ()) - set(largest))
    if not largest:
        return counts.groupBy("base_path").count().select("base_path", F.lit(True).alias("match")).limit(0)
    marked = counts.select("base_path", "config", "n").unionByName(
        totals.select(F.lit(None).cast("string").alias("base_path"), "config", "n")
    )
    wide = marked.groupBy("base_path").pivot("config", largest).agg(F.sum("n"))
    found = F.array_compact(F.array(*(F.col(f"`{c}`") for c in largest)))
    is_total = F.col("base_path").isNull()
    match = F.when(~is_total, F.size(F.array_distinct(found)) <= 1)
    return (
        wide.withColumn("match", match)
        .orderBy(
            is_total,
            *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).desc() for c in largest[:2]),
            "base_path",
        )
        .withColumn("base_path", F.coalesce("base_path", F.lit(TOTAL)))
    )


def path_matches(counts: DataFrame) -> DataFrame:
    """``base_path, n_configs, total, match`` in long form, for any number of configurations."""
    return counts.groupBy("base_path").agg(
        F.count(F.lit(1)).alias("n_configs"),
        F.sum("n").alias("total"),
        (F.min("n") == F.max("n")).alias("match"),
    )


def folder_counts(paths: DataFrame) -> DataFrame:
    """``folder, n, share`` of all listed paths, most frequent first, ties by name."""
    counts = paths.groupBy(path_fn.folder(F.col("path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("folder", "n", (F.col("n") / total).alias("share")).orderBy(F.desc("n"), "folder")


def side_folder_counts(plain: DataFrame, mixture: DataFrame) -> DataFrame:
    """``side, folder, n`` over plain paths and paths inside mixture sources, both ``(side, path)``."""
    both = plain.select("side", "path").unionByName(mixture.select("side", "path"))
    return both.groupBy("side", path_fn.folder(F.col("path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n")
    )


def diff_two(
    left: DataFrame, right: DataFrame, skip: Sequence[str] = (DATASET_PATH_KEY, MIXTURE_KEY)
) -> DataFrame:
    """``key, status, left_value, right_value`` of keys that differ, by key.

    Inputs are ``key, value``. Status is ``left only``, ``right only`` or ``changed``; an empty
    result means no differences. ``skip`` keys (path lists) are left out on both sides.
    """
    def side(settings: DataFrame, name: str) -> DataFrame:
        kept = settings.filter(~F.col("key").isin(*skip)) if skip else settings
        return kept.select("key", F.col("value").alias(f"{name}_value"), F.lit(True).alias(f"_{name}"))

    joined = side(left, "left").join(side(right, "right"), "key", "full_outer")
    status = (
        F.when(F.col("_right").isNull(), "left only")
        .when(F.col("_left").isNull(), "right only")
        .when(~F.col("left_value").eqNullSafe(F.col("right_value")), "changed")
    )
    return (
        joined.select("key", status.alias("status"), "left_value", "right_value")
        .filter(F.col("status").isNotNull())
        .orderBy("key")
    )


def diff_many(settings: DataFrame) -> DataFrame:
    """``config, key, value`` of the keys that differ between configurations.

    A key differs when it has two distinct values or is missing somewhere; the value ``-`` counts as
    missing. Path lists and mixture sources are left out. Distinct values per key are compared by
    their smallest and largest, which needs no list of them. Reads the settings three times.
    """
    key = F.col("key")
    kept = settings.filter(
        ~key.contains(PATH_KEY) & (key != DATA_KEY) & ~key.contains(MIXTURE_KEY)
    ).select("config", "key", F.coalesce("value", F.lit("None")).alias("value"))
    n_configs = settings.agg(F.count_distinct("config")).scalar()
    given = F.when(F.col("value") != MISSING, F.col("value"))
    differing = (
        kept.groupBy("key")
        .agg(F.min(given).alias("low"), F.max(given).alias("high"), F.count(given).alias("n"))
        .filter((F.col("low") != F.col("high")) | (F.col("n") < n_configs))
    )
    return kept.join(differing, "key", "left_semi").select("config", "key", "value")
