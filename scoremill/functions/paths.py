"""Storage paths: normalising, grouping and locating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: paths of this corpus group by their tokenizer folder, not by their last folder.
TOKENIZER_FOLDER = r"(?i)^(.*dclm/.+?tokenizer)(/.*)?$"


def storage_path(path: Column) -> Column:
    """Forward slashes only, without scheme, host, query and leading slashes.

    Host and query are dropped for ``http``, ``https``, ``s3`` and ``gs`` links; other schemes stay.
    """
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    bare = F.regexp_extract(path, r"(?i)^(?:https?|s3|gs):(?://[^/?#]*)?([^?#]*)", 1)
    has_parameters = path.contains(";") & path.rlike("(?i)^https?:")
    bare = F.when(has_parameters, F.regexp_replace(bare, ";[^/]*$", "")).otherwise(bare)
    return F.ltrim(F.when(path.rlike("(?i)^(https?|s3|gs):"), bare).otherwise(path), F.lit("/"))


def collapse(path: Column) -> Column:
    """Drop empty and ``.`` parts and resolve ``..``; an empty relative path is ``.``.

    Most paths need none of this and are passed through after one regular expression.
    """
    root = (
        F.when(path.rlike("^//([^/]|$)"), F.lit("//"))
        .when(path.startswith("/"), F.lit("/"))
        .otherwise(F.lit(""))
    )
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))

    def step(kept: Column, part: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(part != "..", F.concat(kept, F.array(part)))
            .when(can_pop, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(root != "", kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    resolved = F.when(
        path.rlike(r"(^|/)\.\.(/|$)"),
        F.aggregate(parts, F.array().cast("array<string>"), step),
    ).otherwise(parts)
    text = F.concat(root, F.array_join(resolved, "/"))
    return (
        F.when(~path.rlike(r"//|(^|/)\.\.?(/|$)|./$|^$"), path)
        .when(text == "", F.lit("."))
        .otherwise(text)
    )


def folder(path: Column) -> Column:
    """Everything before the last component; empty when there is only one."""
    head = F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)
    return F.when(head.rlike("^/*$"), head).otherwise(F.rtrim(head, F.lit("/")))


def base_path(path: Column) -> Column:
    """Group of a path that :func:`storage_path` has normalised.

    Give a column of a frame rather than an expression: the path is looked at several times.
    """
    tokenizer = F.regexp_extract(path, TOKENIZER_FOLDER, 1)
    in_corpus = F.lower(path).contains("/dclm/")
    last = F.length(F.substring_index(path, "/", -1))
    head = path.substr(F.lit(1), F.length(path) - last - 1)
    return (
        F.when(in_corpus & (tokenizer != ""), tokenizer)
        .when(
            path.contains("/"),
            collapse(F.when(in_corpus, path).otherwise(head)),
        )
        .otherwise(path)
    )


def with_location(
    frame: DataFrame, path: str = "path", name: str = "located", mounts: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Add a struct of protocol, path and derived forms of a path column.

    ``mounts`` names the folders that are network mounts. They come first (absolute paths and ``weka://`` links), then local files, then
    ``s3*`` and ``gs``/``gcs`` links. Anything else fails the query, or gives a null struct when
    not ``strict``. A trailing slash is kept once. ``remote``, ``bucket`` and ``prefix`` are null
    for files; ``local`` is null for object stores.

    The steps are projections of their own, so that no expression contains another many times.
    """
    mount = "|".join(m.replace(".", r"\.") for m in mounts)
    link = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://)?([^?#]*)"
    raw, scheme, rest, mounted = F.col(path), F.col("_scheme"), F.col("_rest"), F.col("_mounted")
    clean = F.regexp_replace(F.regexp_replace(raw, r"(/\.)+(/|$)", "/"), "/+", "/")
    first = frame.withColumns(
        {
            "_scheme": F.lower(F.regexp_extract(raw, link, 1)),
            "_rest": F.regexp_extract(raw, link, 2),
            "_mounted": F.regexp_extract(clean, rf"^(/weka)?(/({mount})(/.*)?)$", 2) if mounts else F.lit(""),
        }
    )
    host = F.substring_index(rest, "/", 1)
    prot = (
        F.when(scheme == "", F.when(mounted != "", "weka").otherwise("file"))
        .when((scheme == "weka") & (host.isin(*mounts) if mounts else F.lit(False)), "weka")
        .when(scheme == "file", "file")
        .when(scheme.startswith("s3"), "s3")
        .when(scheme.isin("gs", "gcs"), "gs")
    )
    if strict:
        problem = F.raise_error(F.concat(F.lit("cannot locate path: "), raw)).cast("string")
        prot = F.coalesce(prot, problem)
    place = (
        F.when(scheme == "", F.when(mounted != "", mounted).otherwise(raw))
        .when(scheme.isin("weka", "file"), F.regexp_replace(F.concat(F.lit("/"), rest), "^/+([^/]*)/*", "/$1/"))
        .otherwise(F.regexp_replace(rest, "^([^/]*)/*", "$1/"))
    )
    second = first.withColumns({"_prot": prot, "_place": place})
    prot, place = F.col("_prot"), F.col("_place")
    inner = F.when(prot != "file", F.ltrim(place, F.lit("/")))
    third = second.withColumn("_inner", inner)
    inner = F.col("_inner")
    located = F.struct(
        prot.alias("prot"),
        place.alias("path"),
        F.substring_index(inner, "/", 1).alias("bucket"),
        F.regexp_replace(inner, "^[^/]*/*", "").alias("prefix"),
        F.when(prot.isin("weka", "file"), place).alias("local"),
        F.concat(prot, F.lit("://"), inner).alias("remote"),
        F.md5(F.concat(prot, place)).alias("hash"),
    )
    return third.withColumn(name, F.when(prot.isNotNull(), located)).drop(
        "_scheme", "_rest", "_mounted", "_prot", "_place", "_inner"
    )


GLOB = r"[*?\[]"


def is_glob(path: Column) -> Column:
    return path.rlike(GLOB)


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a whole path for a glob: ``**`` spans folders, ``*`` and ``?`` stay within one."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    steps = (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("[!", "[^"), ("\x01", "(?:[^/]+/)*"), ("\x02", ".*"))
    for glob, regex in steps:
        quoted = F.replace(quoted, F.lit(glob), F.lit(regex))
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def glob_root(pattern: Column) -> Column:
    """The folders in front of the first component with a wildcard."""
    return F.regexp_replace(F.regexp_extract(pattern, r"^([^*?\[]*)", 1), "[^/]*$", "")


def source_path(path: Column) -> Column:
    """Path a job can read: mounts by folder, ``s3`` and ``gs`` as they are, other links refused."""
    scheme = F.lower(F.regexp_extract(path, r"^([A-Za-z0-9]+)://", 1))
    return (
        F.when(scheme == "", F.when(path.rlike("^/+$"), path).otherwise(F.rtrim(path, F.lit("/"))))
        .when(scheme.isin("s3", "gs"), path)
        .when(scheme == "weka", F.rtrim(F.regexp_replace(path, "^weka://", "/weka/"), F.lit("/")))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported scheme: "), path)).cast("string"))
    )


def scheme_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
