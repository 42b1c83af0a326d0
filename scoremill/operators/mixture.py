"""Data sources of a training mix: token counts, natural ratios and the resolved mix.

``sources(name, target_ratio, repetition_factor, max_source_ratio)`` has one row per source,
``source_paths(name, path)`` one row per file or pattern of a source. Tables of several recipes carry a column
``config`` as well; then everything is per recipe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremill.functions import paths as path_fn

# Bytes per token of the token array types.
ITEM_BYTES = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8}
DEFAULT_DTYPE = "uint32"
DEFAULT_SEED = 42


MARK = "\x03"  # stands for the wildcard "?", which links end at


def _config(frame: DataFrame) -> list[str]:
    return ["config"] if "config" in frame.columns else []


def attach_sizes(source_paths: DataFrame, files: DataFrame) -> DataFrame:
    """``source, path, length`` of listed paths; the length is null for a path without a file.

    ``source_paths`` is ``name, path``, ``files`` is ``path, length``, each file once. Paths meet by protocol and
    place, so that ``s3a://`` or ``file:`` forms of a listing match the ``s3://`` or plain forms. A pattern gives
    a row for each of its files, with the file's path: patterns meet the files below the folders in front of
    their first wildcard.
    """
    by = _config(source_paths)

    def place(frame: DataFrame, *columns) -> DataFrame:
        at = path_fn.with_location(frame, "_raw", "_at")
        return at.select(F.col("_at.prot").alias("_prot"), F.col("_at.path").alias("_place"), *columns)

    raw = F.replace("path", F.lit("?"), F.lit(MARK))
    listed = place(source_paths.withColumn("_raw", raw), *by, F.col("name").alias("source"), "path")
    found = place(files.withColumn("_raw", raw), "length", F.col("path").alias("file"))
    globs = path_fn.is_glob(F.col("path"))
    plain = listed.filter(~globs).join(found.drop("file"), ["_prot", "_place"], "left")
    pattern = F.replace("_place", F.lit(MARK), F.lit("?"))
    wanted = listed.filter(globs).select(
        *by, "source", "path", "_prot", path_fn.glob_root(pattern).alias("_root"), path_fn.glob_regex(pattern).alias("_regex")
    )
    # every folder above a file, with its trailing slash, once
    parts = F.split("_place", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))
    )
    # a listing without folders has one empty root
    roots = F.when(F.size(parts) > 1, F.array_union(F.array(F.lit("")), above)).otherwise(F.array(F.lit("")))
    below = found.select(F.col("_prot").alias("_p"), "_place", "length", "file", F.explode(roots).alias("_above"))
    meets = (F.col("_prot") == F.col("_p")) & (F.col("_root") == F.col("_above")) & F.rlike(F.col("_place"), F.col("_regex"))
    matched = wanted.join(below, meets, "left").select(*by, "source", F.coalesce("file", "path").alias("path"), "length")
    return plain.select(*by, "source", "path", "length").unionByName(matched)


def token_counts(files: DataFrame, dtype: str = DEFAULT_DTYPE) -> DataFrame:
    """``source, tokens, n_files, n_failed, ratio, dtype`` from ``files(source, length)``.

    A file holds ``length div item size`` tokens; a file whose length is null could not be read and
    is counted in ``n_failed``. No tokens at all (of a ``config``) fails the query. The total sums all columns of the
    per-source aggregation: a plan that needs the same columns shares its shuffle, so files are read
    once.
    """
    by = _config(files)
    counts = files.groupBy(*by, "source").agg(
        F.coalesce(F.sum(F.expr(f"length div {ITEM_BYTES[dtype]}")), F.lit(0)).alias("tokens"),
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("length").isNull()).alias("n_failed"),
    )
    if by:
        total = F.col("total")
        totals = counts.groupBy("config").agg(F.sum("tokens").alias("total"))
        counts = counts.join(totals, "config")
    else:
        sums = [F.sum(column).alias(column) for column in ("tokens", "n_files", "n_failed")]
        total = counts.agg(F.struct(*sums)).scalar()["tokens"]
    none = F.raise_error(F.lit("no tokens found in any source")).cast("double")
    ratio = F.when(total == 0, none).otherwise(F.col("tokens") / total)
    return counts.select(
        *by, "source", "tokens", "n_files", "n_failed", ratio.alias("ratio"), F.lit(dtype).alias("dtype")
    )


def validate_sources(sources: DataFrame) -> DataFrame:
    """The sources unchanged; fails the query when only some (of a ``config``) have a ``target_ratio``.

    The test is a filter, which no choice of columns takes away.
    """
    some = F.count("target_ratio") > 0
    if by := _config(sources):
        given = sources.groupBy(*by).agg(some.alias("_given"))
        tested, state = sources.join(given, by), F.col("_given")
    else:
        tested, state = sources, sources.agg(some.alias("given")).scalar()
    problem = F.raise_error(
        F.concat(F.lit("all sources or none must have a target_ratio; missing for "), F.col("name"))
    ).cast("boolean")
    bad = F.col("target_ratio").isNull() & state
    return tested.filter(F.when(bad, problem).otherwise(True)).select(sources.columns)


def validate_schemes(source_paths: DataFrame) -> DataFrame:
    """``name, n_paths, scheme`` per source; fails the query when a source mixes URL schemes."""
    scheme = path_fn.scheme_of(F.col("path"))
    by = _config(source_paths)
    found = source_paths.groupBy(*by, "name").agg(
        F.count(F.lit(1)).alias("n_paths"), F.min(scheme).alias("scheme"), F.max(scheme).alias("_last")
    )
    problem = F.raise_error(F.concat(F.lit("mixed URL schemes in source "), F.col("name"))).cast("boolean")
    good = F.when(F.col("scheme") != F.col("_last"), problem).otherwise(True)
    return found.filter(good).select(*by, "name", "n_paths", "scheme")


def resolve_ratios(sources: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """``name, ratio, repetition_factor``: the target ratio, else the natural one.

    ``priors`` is ``source, ratio``. A target of 0 falls through to the natural ratio. A source
    with neither fails the query.
    """
    target = F.nullif(F.col("target_ratio"), F.lit(0.0))
    unknown = F.raise_error(F.concat(F.lit("no ratio for source "), F.col("name"))).cast("double")
    by = _config(sources)
    if priors is None:
        return sources.select(*by, "name", F.coalesce(target, unknown).alias("ratio"), "repetition_factor")
    natural = priors.select(*by, F.col("source").alias("name"), F.col("ratio").alias("natural"))
    return sources.join(natural, [*by, "name"], "left").select(
        *by, "name", F.coalesce(target, F.col("natural"), unknown).alias("ratio"), "repetition_factor"
    )


def mix_plan(
    ratios: DataFrame,
    source_paths: DataFrame,
    max_tokens: int,
    sequence_length: int,
    seed: int = DEFAULT_SEED,
    dtype: str = DEFAULT_DTYPE,
) -> DataFrame:
    """One row per path with everything a loader needs.

    A mix (of a ``config``) is fractional when any ratio is not 1; then ``ratio``, ``repetition_factor`` and
    ``max_tokens`` apply. Otherwise the paths are simply concatenated and those columns are null.
    A source without any path fails the query.
    """
    by = _config(ratios)
    some = F.coalesce(F.max((F.col("ratio") != 1).cast("int")), F.lit(0)) == 1
    joined = ratios.join(source_paths, [*by, "name"], "left")
    if by:
        joined = joined.join(ratios.groupBy(*by).agg(some.alias("_fractional")), by)
        fractional = F.col("_fractional")
    else:
        fractional = ratios.agg(some).scalar()
    empty = F.raise_error(F.concat(F.lit("no paths found for source "), F.col("name"))).cast("boolean")
    joined = joined.filter(F.when(F.col("path").isNull(), empty).otherwise(True))

    def if_fractional(col):
        return F.when(F.col("is_fractional"), col)

    return joined.select(
        *by, "name", "path", "ratio", "repetition_factor", fractional.alias("is_fractional")
    ).select(
        *by,
        "name",
        "path",
        "is_fractional",
        if_fractional(F.col("ratio")).alias("ratio"),
        if_fractional(F.col("repetition_factor")).alias("max_repetition_ratio"),
        if_fractional(F.lit(max_tokens).cast("bigint")).alias("max_tokens"),
        F.lit(sequence_length).alias("sequence_length"),
        F.lit(seed).alias("seed"),
        F.lit(dtype).alias("dtype"),
    )


def domain_weights(files: DataFrame, mix: str, domain: str, size: str) -> DataFrame:
    """``mix, domain, weight``: natural weights, the share of each domain's size in its mix.

    Partial sums per (mix, domain); the totals per mix are summed from those.
    """
    sums = files.groupBy(F.col(mix).alias("mix"), F.col(domain).alias("domain")).agg(
        F.sum(size).alias("_size")
    )
    totals = sums.groupBy("mix").agg(F.sum("_size").alias("_total"))
    return sums.join(totals, "mix").select(
        "mix", "domain", (F.col("_size") / F.col("_total")).alias("weight")
    )


def compare_weights(natural: DataFrame, target: DataFrame) -> DataFrame:
    """``domain, natural, target`` of two weight tables ``domain, weight``; null where one lacks it."""
    return natural.select("domain", F.col("weight").alias("natural")).join(
        target.select("domain", F.col("weight").alias("target")), "domain", "full_outer"
    )
