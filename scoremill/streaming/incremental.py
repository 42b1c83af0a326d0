"""Streams of metric records: landing each experiment once, and keeping the newest score per key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoremill.operators.newest import newest
from scoremill.sources.landing import IDENTITY, land

COMPACTED = "compacted"


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the query that a checkpoint belongs to; a new checkpoint is a new query, whose batches start at 0."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]


def land_stream(
    stream: DataFrame, table: str, checkpoint: str, identity: Sequence[str] = IDENTITY
) -> StreamingQuery:
    """Land what has arrived so far and stop; call again for later arrivals.

    Holds the same records as landing everything at once, however the input is cut into batches. A repeated
    batch replaces its own folder, which carries the query's identity, so another query never does.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        land(spark, table, batch, number, identity=identity, writer=query_id(spark, checkpoint))

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_stream(
    stream: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Continuously newest record per key, as an update stream.

    A stateful aggregation: the state holds one record per key, partial maxima are taken before the
    shuffle, and a late older record never replaces a newer one. ``order`` is largest first and must
    be total.
    """
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    best = F.max(F.struct(rank.alias("_rank"), *values)).alias("_best")
    return stream.groupBy(*keys).agg(best).select(
        *keys, *(F.col(f"_best.{v}").alias(v) for v in values), F.col("_best._rank").alias("_rank")
    )


def write_updates(updates: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of updates to ``table`` in a folder of its own, then stop when caught up."""
    def save(batch: DataFrame, number: int) -> None:
        writer = query_id(batch.sparkSession, checkpoint)
        batch.write.mode("overwrite").parquet(f"{table}/writer={writer}/batch={number}")

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_newest(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """Current record per key from the written updates."""
    updates = spark.read.parquet(table)
    return newest(updates, keys, [F.desc("_rank")]).drop("_rank", "writer", "batch")


def compact(spark: SparkSession, table: str, keys: Sequence[str]) -> None:
    """Replace the written updates by one row per key.

    The rows are written first and the folders they were made of removed then; as the newest counts, a job lost in
    between leaves the same result. Updates written meanwhile stay. A stream that repeats a removed batch writes
    it again.
    """
    updates = spark.read.parquet(table)
    folders = [tuple(r) for r in updates.select("writer", "batch").distinct().collect()]
    # only folders that were listed before are read, whatever is written meanwhile
    listed = spark.read.option("basePath", table).parquet(*(f"{table}/writer={w}/batch={b}" for w, b in folders))
    best = newest(listed, keys, [F.desc("_rank")]).drop("writer", "batch")
    best.write.parquet(f"{table}/writer={COMPACTED}-{uuid.uuid4().hex}/batch=0")
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for writer, batch in folders:
        path = paths(f"{table}/writer={writer}/batch={batch}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

