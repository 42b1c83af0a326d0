"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremill.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links from the neighbours of each node to its smallest one.

    The large star moves neighbours above the node, the small star the node itself and neighbours below it. The
    smallest neighbour is an aggregate joined back, so a node's neighbours are never gathered.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    # a is the node; in the small star a > b already
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        target = F.least("least", "a")
        return joined.where("b > a").select(F.col("b").alias("a"), target.alias("b")).distinct()
    down = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return down.union(joined.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node of its component.

    Links may repeat, run either way or join a node to itself (which says nothing). Each round is written to the
    shared folder, so no lineage grows; rounds go with the logarithm of the longest path.
    """
    current = stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = None
    while True:
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if mark == seen:
            break
        seen = mark
        current = stage(_star(_star(current, True), False))
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
