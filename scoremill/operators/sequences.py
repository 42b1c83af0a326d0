"""Documents laid end to end: shards of a maximum size, packed sequences of a fixed length, padded documents.

All rest on where a document starts, which is the total size of those before it. That prefix sum is distributed: keys
and sizes are dealt by range into parts, each part is added up, the parts' totals give offsets, and a running sum within
each part does the rest. No window runs over all rows; only one over the parts' totals does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremill.session import stage


def starts(sizes: DataFrame, order: Sequence[str], size: str = "size") -> DataFrame:
    """``sizes`` with the column ``start``: the sum of ``size`` over all rows before a row by ``order``.

    ``order`` must tell rows apart; sizes are non-negative longs, a null counts as 0. Rows should be narrow: they are
    shuffled twice.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = sizes.withColumn(size, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))
    dealt = stage(whole.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.withColumn("start", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return running.join(offsets, "_part").withColumn("start", F.col("start") + F.col("_offset")).drop("_part", "_offset")


def lay_out(docs: DataFrame, size: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, copy, size, start) for every row, in the order of ids (null first), then texts' digests.

    Rows equal in id and text are copies 0, 1, ... that follow each other. ``size`` is an expression over a row.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), row_key("text").alias("key"), size.cast("long").alias("size"))
    rows = keyed.groupBy("doc_id", "key").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    total = F.coalesce("size", F.lit(0)) * F.col("copies")
    laid = starts(rows.withColumn("total", total), ["doc_id", "key"], "total")
    each = laid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    length = F.coalesce("size", F.lit(0))
    return each.select("doc_id", "key", "copy", length.alias("size"), (F.col("start") + F.col("copy") * length).alias("start"))


def row_key(text: str = "text") -> Column:
    """Digest that tells texts apart; null has one of its own."""
    return F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))


def shards(laid: DataFrame, most: int) -> DataFrame:
    """``laid`` with the shard a document starts in; it is never split, so a shard holds less than ``most`` and one document."""
    return laid.withColumn("shard", F.expr(f"start div {int(most)}"))


def pieces(laid: DataFrame, length: int, tail: bool = False) -> DataFrame:
    """What each sequence of ``length`` takes of each document: (sequence, at, doc_id, key, copy, begin, size).

    ``at`` is the place in the sequence, ``begin`` that in the document, both from 0. Sequences follow each other
    without a gap; the last one goes if it is short, unless ``tail`` is set. A document without a size is in none, one
    that spans sequences is cut at their borders, however long it is.
    """
    span = laid.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    cut = span.select("*", F.explode(F.expr(f"sequence(start div {length}, (end - 1) div {length})")).alias("sequence"))
    low = F.greatest(F.col("start"), F.col("sequence") * length)
    high = F.least(F.col("end"), (F.col("sequence") + 1) * length)
    out = cut.select(
        "sequence",
        (low - F.col("sequence") * length).alias("at"),
        "doc_id",
        "key",
        "copy",
        (low - F.col("start")).alias("begin"),
        (high - low).alias("size"),
    )
    if tail:
        return out
    full = laid.agg(F.expr(f"coalesce(sum(size), 0) div {length}").alias("n")).first()["n"]
    return out.where(F.col("sequence") < full)


def pack(docs: DataFrame, text: str, length: int, tail: bool = False, doc_id: str = "doc_id") -> DataFrame:
    """(sequence, value): documents joined end to end and cut every ``length`` characters, or elements of an array.

    ``text`` names a string or array column. A sequence is put together from its pieces only, so a task holds at most
    ``length`` of it at a time.
    """
    is_array = docs.schema[text].dataType.typeName() == "array"
    column = F.col(text)
    size_of = F.size if is_array else F.length
    digest = F.array_join(column.cast("array<string>"), ",", "null") if is_array else column
    own = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("text"), column.alias("value"), size_of(column).alias("size"))
    laid = stage(lay_out(own, F.col("size")))
    # one key without nulls, so that copies are dropped and joined in one exchange; a row carries its value to all copies
    joint = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key").alias("joint")
    values = own.select("doc_id", row_key().alias("key"), "value").where(size_of("value") > 0).select(joint, "value").dropDuplicates(["joint"])
    cut = pieces(laid, length, tail).select("sequence", "at", "begin", F.col("size").alias("n"), joint)
    joined = cut.join(values, "joint")
    part = F.slice("value", F.col("begin") + 1, F.col("n")) if is_array else F.expr("substring(value, cast(begin as int) + 1, cast(n as int))")
    listed = F.sort_array(F.collect_list(F.struct("at", part.alias("part"))))
    whole = F.flatten(F.transform("listed", lambda x: x["part"])) if is_array else F.concat_ws("", F.transform("listed", lambda x: x["part"]))
    return joined.groupBy("sequence").agg(listed.alias("listed")).select("sequence", whole.alias("value"))


def pad(values: Column, length: int, filler: Column) -> Column:
    """An array cut to ``length`` elements, or filled up to it; null is empty."""
    known = F.slice(F.coalesce(values, F.array().cast("array<int>")), 1, length)
    return F.concat(known, F.array_repeat(filler, F.lit(length) - F.size(known)))
