"""The mix query: recipe to sources, token universe, ratios and the plan a loader reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremill.functions import paths as path_fn
from scoremill.operators import manifest, mixture
from scoremill.session import stage


def recipe_sources(recipes: DataFrame) -> DataFrame:
    """One row per named source of parsed recipes."""
    return recipes.filter(F.col("source").isNotNull()).groupBy(
        "config", F.col("source").alias("name")
    ).agg(
        F.max("target_ratio").alias("target_ratio"),
        F.max("repetition_factor").alias("repetition_factor"),
        F.max("max_source_ratio").alias("max_source_ratio"),
    )


def recipe_patterns(recipes: DataFrame) -> list[str]:
    """Paths and patterns of the recipes, on the driver, which lists their files."""
    named = recipes.filter(F.col("source").isNotNull() & F.col("path").isNotNull())
    return [r["path"] for r in named.select("path").distinct().orderBy("path").collect()]


def recipe_plan(
    recipes: DataFrame,
    files: DataFrame,
    max_tokens: int,
    sequence_length: int,
    seed: int = mixture.DEFAULT_SEED,
    dtype: str = mixture.DEFAULT_DTYPE,
) -> DataFrame:
    """Mix plans of all recipes, a row per recipe, source and file.

    ``files(path, length)`` lists the files of all patterns (``manifests.expand_files``); patterns are expanded
    from it, and natural ratios come from the lengths of a recipe's own files. Fails the query for a source without
    files, with several URL schemes, or without a target ratio where others have one.
    """
    sources = mixture.validate_sources(recipe_sources(recipes))
    listed = recipes.filter(F.col("source").isNotNull() & F.col("path").isNotNull()).select(
        "config", F.col("source").alias("name"), "path"
    )
    one_scheme = mixture.validate_schemes(listed).select("config", "name")
    listed = listed.join(one_scheme, ["config", "name"], "left_semi")
    sized = stage(mixture.attach_sizes(listed, files))
    ratios = mixture.resolve_ratios(sources, mixture.token_counts(sized, dtype))
    # a listing may name the same store in another way than the recipe
    plain = F.regexp_replace(F.regexp_replace("path", "^s3[an]://", "s3://"), "^file:(//)?", "")
    paths = sized.filter(F.col("length").isNotNull()).select(
        "config", F.col("source").alias("name"), path_fn.source_path(plain).alias("path")
    )
    return mixture.mix_plan(ratios, paths, max_tokens, sequence_length, seed, dtype)


def compare_path_lists(paths: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """Table of token files per base path and configuration, with totals and match marks."""
    return manifest.path_table(manifest.path_counts(manifest.token_files(paths)), configs)
