"""Experiment tags: ``array<struct<key,value>>`` and its text form ``k=v,flag``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS_TYPE = "array<struct<key:string,value:string>>"


def parse_tags(text: Column) -> Column:
    """Split ``k=v,flag``: a bare ``flag`` is ``flag=flag``; a second ``=`` fails the query."""
    def one(piece: Column) -> Column:
        key = F.substring_index(piece, "=", 1)
        value = F.when(piece.contains("="), F.regexp_replace(piece, "^[^=]*=", "")).otherwise(piece)
        bad = F.raise_error(F.concat(F.lit("a tag value may not contain '=': "), piece)).cast("string")
        return F.struct(key.alias("key"), F.when(value.contains("="), bad).otherwise(value).alias("value"))

    trimmed = F.btrim(text, F.lit(" \t\r\n\f\v"))
    return F.coalesce(F.transform(F.split(trimmed, ","), one), F.array().cast(TAGS_TYPE))


def render_tags(tags: Column) -> Column:
    """Inverse of :func:`parse_tags`; ``flag=flag`` prints as ``flag``."""
    def one(tag: Column) -> Column:
        return F.when(tag["key"] == tag["value"], tag["key"]).otherwise(
            F.concat(tag["key"], F.lit("="), tag["value"])
        )

    return F.array_join(F.transform(tags, one), ",")


def tag(key: str, value: str) -> Column:
    for part in (key, value):
        if "=" in part or "," in part:
            raise ValueError(f"a tag may not contain '=' or ',': {part!r}")
    return F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))


def has_tag(tags: Column, key: str, value: str) -> Column:
    return F.exists(tags, lambda t: (t["key"] == key) & (t["value"] == value))


def with_tag(tags: Column, key: str, value: str) -> Column:
    """Add one tag and keep the others."""
    return F.array_union(tags, F.array(tag(key, value)))


def without_tag(tags: Column, key: str, value: str) -> Column:
    return F.filter(tags, lambda t: ~((t["key"] == key) & (t["value"] == value)))
