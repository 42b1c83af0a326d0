"""Path lists, recipes, file sizes and domain weights."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scoremill.functions import paths as path_fn
from scoremill.operators.mixture import attach_sizes
from scoremill.session import local_table

FLAT_TYPE = "config string, key string, value string"
DEEP = "**"
PIECE = 10_000  # rows per Arrow batch that a text parser hands back


def parse_mix_lines(lines: DataFrame) -> DataFrame:
    """``config, path`` of token files from ``config, line``.

    Blank lines and lines starting with ``#`` are skipped; of ``label,path,...`` the second field
    counts; only ``.npy`` paths are kept.
    """
    line = F.btrim("line", F.lit(" \t\r\n\f\v"))
    path = F.when(F.col("line").contains(","), F.split("line", ",")[1]).otherwise(F.col("line"))
    return (
        lines.withColumn("line", line)
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select("config", path.alias("path"))
        .filter(F.col("path").endswith(".npy"))
    )


def read_mix_lists(spark: SparkSession, path: str) -> DataFrame:
    """Mix list files; the configuration is the file name."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("config"), F.col("value").alias("line")
    )
    return parse_mix_lines(lines)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``config, text``; for configurations, which are small."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("config"), F.col("value").alias("text")
    )


def flatten(configs: DataFrame, syntax: str = "json", sep: str = ".", include_lists: bool = False) -> DataFrame:
    """``config, key, value`` of nested configuration texts ``config, text``.

    Keys join with ``sep``. Lists are leaves unless ``include_lists``, when their indices are keys.
    An empty mapping gives no key. Leaf text is a string as it is, JSON text for other values, and
    null for null. Texts that are not mappings give no rows.
    """
    load = _loader(syntax)

    def leaves(config, text):
        for key, value in _leaves(load(text), sep, include_lists):
            if value is not None and not isinstance(value, str):
                value = json.dumps(value, default=str)
            yield config, key, value

    return _map_texts(configs, leaves, FLAT_TYPE)


RECIPE_TYPE = (
    "config string, source string, target_ratio double, repetition_factor double, "
    "max_source_ratio double, path string"
)


def parse_recipes(configs: DataFrame, syntax: str = "yaml") -> DataFrame:
    """One row per configuration, source and path, from ``config, text``.

    ``dataset.sources[]`` gives named sources; a plain ``data.paths`` list gives source null. A
    source without paths gives one row with path null.
    """
    load = _loader(syntax)

    def paths(config, text):
        recipe = load(text) or {}
        for path in (recipe.get("data") or {}).get("paths") or []:
            yield config, None, None, None, None, path
        for s in (recipe.get("dataset") or {}).get("sources") or []:
            target = s.get("target_ratio")
            factors = float(s.get("repetition_factor", 1)), float(s.get("max_source_ratio", 1))
            for path in s.get("paths") or [None]:
                yield config, s["name"], None if target is None else float(target), *factors, path

    return _map_texts(configs, paths, RECIPE_TYPE)


RUN_PATHS = (
    "data struct<paths:array<string>>, dataset struct<paths:array<string>, "
    "source_mixture_config:struct<source_configs:array<struct<paths:array<string>>>>>"
)


def run_config_paths(configs: DataFrame) -> DataFrame:
    """``config, origin, path`` of the path lists in JSON run configurations ``config, text``.

    ``origin`` is ``data`` or ``dataset`` for plain lists and ``mixture`` for those of mixture sources.
    """
    parsed = configs.select("config", F.inline(F.array(F.from_json("text", RUN_PATHS))))
    sources = F.col("dataset.source_mixture_config.source_configs")
    listed = {
        "data": F.col("data.paths"),
        "dataset": F.col("dataset.paths"),
        "mixture": F.flatten(F.filter(sources["paths"], lambda paths: paths.isNotNull())),
    }
    lists = F.array(*(F.struct(F.lit(o).alias("origin"), p.alias("paths")) for o, p in listed.items()))
    return (
        parsed.select("config", F.explode(lists).alias("l"))
        .select("config", "l.origin", F.explode("l.paths").alias("path"))
    )


def recipe_paths(recipes: DataFrame) -> DataFrame:
    """``config, path`` of the token files of recipes, cleaned like the lines of a mix list."""
    return parse_mix_lines(
        recipes.filter(F.col("path").isNotNull()).select("config", F.col("path").alias("line"))
    )


def expand_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """``path, length`` of all files of the patterns; a pattern without a match raises.

    Spark lists the files and never opens them: the content column is not selected. All patterns
    without ``**`` are one listing, all others a second, recursive one below the folders in front of ``**``.
    ``**`` stands for any number of folders, and at the end for all files below. A file is listed once, whatever
    patterns it matches.
    """
    flat = [p for p in patterns if DEEP not in p]
    deep = [p for p in patterns if DEEP in p]
    found = [spark.read.format("binaryFile").load(flat).select("path", "length")] if flat else []
    if deep:
        found.append(_deep_files(spark, deep))
    return found[0].distinct() if len(found) == 1 else found[0].unionByName(found[1]).distinct()


def source_files(spark: SparkSession, sources: dict[str, list[str]]) -> DataFrame:
    """``source, path, length`` of the files of named sources; a source without files raises.

    All sources share one listing, whose files meet the sources' patterns in a join.
    """
    for name, patterns in sources.items():
        if not patterns:
            raise ValueError(f"no paths found for source {name}")
    listed = [(name, pattern) for name, patterns in sources.items() for pattern in patterns]
    files = expand_files(spark, sorted({p for _, p in listed}))
    return attach_sizes(local_table(spark, listed, "name string, path string"), files)


def read_domain_weights(spark: SparkSession, path: str, folder_per_mix: bool = False) -> DataFrame:
    """``mix, domain, weight`` of JSON files that hold a list of ``{domain, weight}``.

    The mix is the file name without its extension. With ``folder_per_mix`` it is the name of the
    folder, and files hold one object per line, as Spark writes them.
    """
    reader = spark.read.schema("domain string, weight double")
    if folder_per_mix:
        mix = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
        return reader.json(path).select(mix.alias("mix"), "domain", "weight")
    mix = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return reader.option("multiLine", "true").json(path).select(mix.alias("mix"), "domain", "weight")


def _deep_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    # folders in front of the component with "**", which may hold other wildcards
    roots = sorted({p[: p.index(DEEP)].rpartition("/")[0] or "/" for p in patterns})
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(roots).select("path", "length")
    place = F.regexp_replace("path", "^file:(//)?", "")
    hits = [F.rlike(place, path_fn.glob_regex(F.lit(p.removeprefix("file:")))) for p in patterns]
    counts = files.agg(*(F.count_if(hit).alias(str(i)) for i, hit in enumerate(hits))).first()
    for pattern, n in zip(patterns, counts):
        if not n:
            raise FileNotFoundError(pattern)
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return files.filter(any_hit)


def _map_texts(configs: DataFrame, parse: Callable, ddl: str) -> DataFrame:
    """Rows that ``parse(config, text)`` yields, handed to Spark in pieces of bounded size."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = (row for pair in zip(*(c.to_pylist() for c in batch.columns)) for row in parse(*pair))
            while piece := list(islice(parsed, PIECE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, type=field.type) for column, field in zip(zip(*piece), schema)], schema=schema
                )

    return configs.select("config", "text").mapInArrow(rows, ddl)


def _loader(syntax: str):
    if syntax == "json":
        return json.loads
    if syntax != "yaml":
        raise ValueError(f"syntax is json or yaml, not {syntax!r}")
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML recipes needs PyYAML") from error
    return yaml.safe_load


def _leaves(node, sep: str, include_lists: bool, prefix: str = ""):
    if include_lists and isinstance(node, list):
        node = {str(i): item for i, item in enumerate(node)}
    if isinstance(node, dict):
        for key, value in node.items():
            yield from _leaves(value, sep, include_lists, f"{prefix}{sep}{key}" if prefix else str(key))
    elif prefix:
        yield prefix, node
