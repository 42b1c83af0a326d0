"""Documents that share word n-grams with evaluation items.

Tokens are runs of ``[a-z0-9]`` of the text with A-Z in lower case. A document and an item are linked by every n-gram
they share, whole n-grams compared. Documents are large and items few, so the items make a runtime filter first:
marks at the hashes of the first, middle and last token of their n-grams. Only n-grams of documents that pass it are
built and leave their row; the equi-join decides. The filter has a fixed size: with more items it lets more pass, and
the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremill.session import stage

N = 13
TOKEN = r"[a-z0-9]+"
SLOTS = 1 << 17  # of the runtime filter, a byte each
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens(text: Column) -> Column:
    """Tokens in order; an empty array for a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(lower, F.lit(TOKEN), F.lit(0))


def _starts(words: Column, n: int) -> Column:
    """Places (from 1) where an n-gram starts."""
    size = F.size(words)
    return F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))


def _slot(words: Column, at: Column, n: int) -> Column:
    parts = [F.get(words, at - 1 + k) for k in sorted({0, n // 2, n - 1})]
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS))


def _gram(words: Column, at: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(words, at, n))


def item_grams(items: DataFrame, n: int = N, item_id: str = "item_id") -> DataFrame:
    """(item_id, gram, slot, item_grams): distinct n-grams of every item and how many it has. Repeated ids are one item."""
    words = items.select(F.col(item_id).alias("item_id"), tokens(F.col("text")).alias("w"))
    at = words.select("item_id", "w", F.explode(_starts(F.col("w"), n)).alias("at"))
    grams = at.select("item_id", _gram(F.col("w"), F.col("at"), n).alias("gram"), _slot(F.col("w"), F.col("at"), n).alias("slot")).distinct()
    sizes = grams.groupBy("item_id").agg(F.count("*").alias("item_grams"))
    return grams.join(sizes, grams["item_id"].eqNullSafe(sizes["item_id"])).drop(sizes["item_id"])


def _filter(grams: DataFrame) -> Column:
    """The runtime filter, of one size whatever the number of n-grams."""
    marks = bytearray(SLOTS)
    for r in grams.select("slot").distinct().collect():
        marks[r["slot"]] = 1
    return F.lit(bytes(marks))


def text_key(text: Column) -> Column:
    """Tells texts of one id apart; null is not the empty text."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def shared_grams(docs: DataFrame, grams: DataFrame, n: int = N, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, item_id, item_grams, gram) for every distinct n-gram that a row of ``docs`` shares with an item."""
    marks = _filter(grams)
    words = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col("text")).alias("key"), tokens(F.col("text")).alias("w"))

    def passes(at: Column) -> Column:
        return F.substring(marks, _slot(F.col("w"), at, n) + 1, F.lit(1)) == F.lit(b"\x01")

    near = words.select("doc_id", "key", "w", F.filter(_starts(F.col("w"), n), passes).alias("at"))
    held = F.array_distinct(F.transform("at", lambda a: _gram(F.col("w"), a, n)))
    found = near.select("doc_id", "key", F.explode(held).alias("gram"))
    return found.join(grams.select("item_id", "item_grams", "gram"), "gram")


def contamination(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, item_id, hits, item_grams, ratio) for every document and item with a shared n-gram.

    ``hits`` counts the item's distinct n-grams that the document holds, ``ratio`` is their share. Null and empty texts
    and those of fewer than n tokens have no n-gram. Rows that repeat an id are one document, null ids among them;
    a very long text leaves its row only where it passes the filter. Empty tables give an empty result.
    """
    grams = stage(item_grams(items, n))
    hits = shared_grams(docs, grams, n).groupBy("doc_id", "item_id", "item_grams").agg(F.count_distinct("gram").alias("hits"))
    return hits.select("doc_id", "item_id", "hits", "item_grams", (F.col("hits") / F.col("item_grams")).alias("ratio"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, least: float = 0.0) -> DataFrame:
    """``docs`` without the rows that hold more than the share ``least`` of an item's distinct n-grams; 0: any at all.

    Each row is judged by its own text, also where rows share an id or have none; all columns stay.
    """
    grams = stage(item_grams(items, n))
    hits = shared_grams(docs, grams, n).distinct().groupBy("doc_id", "key", "item_id", "item_grams").agg(F.count("*").alias("hits"))
    bad = hits.where(F.col("hits") / F.col("item_grams") > least).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, bad["_id"].eqNullSafe(docs["doc_id"]) & (bad["_key"] == text_key(docs["text"])), "left_anti")
