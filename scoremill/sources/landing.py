"""Landing table: metric records that were fetched once and are not fetched again.

``<table>/records`` holds every load in a folder of its own that is never written again. ``<table>/log`` has a row per
load that is done: its writer, batch and version. The newest version of a writer's batch counts, so a batch that is
repeated replaces its own load in one step, a lost job leaves nothing, and no writer replaces another's.
``<table>/evicted`` lists ``(experiment_id, load)``: records of that experiment in that load no longer count; they do
when they land again, which is another load. A record is known by its identity columns, not by its experiment, so an
experiment may arrive in parts, and lands once however the input is cut into batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

ID = "experiment_id"
IDENTITY = (ID, "task_idx", "task_hash")
FOLDER = ("writer", "batch")


def landed(spark: SparkSession, table: str) -> DataFrame | None:
    """Records that count, with their writer and batch; None before the first landing."""
    records, log = _read(spark, f"{table}/records"), _read(spark, f"{table}/log")
    if records is None or log is None:
        return None
    live = log.groupBy(*FOLDER).agg(F.max_by("load", "version").alias("load"))
    records = records.join(live, "load")
    evicted = _read(spark, f"{table}/evicted")
    if evicted is None:
        return records.drop("load")
    return records.join(evicted.select(ID, "load").distinct(), [ID, "load"], "left_anti").drop("load")


def land(
    spark: SparkSession,
    table: str,
    incoming: DataFrame,
    batch: int,
    force: bool = False,
    keep: bool = True,
    identity: Sequence[str] = IDENTITY,
    writer: str = "batch",
) -> DataFrame:
    """Land the incoming records that are not landed yet, and return them.

    Two records are the same if their ``identity`` columns are; nulls are equal. Of the same records in one
    batch the first by its JSON text lands. ``force`` first evicts what the batch's experiments have landed before, so they land again.
    ``keep=False`` returns the incoming records without writing anything. ``writer`` names who numbers the
    batches: a batch number that comes again replaces the load of that writer only.
    """
    new = _once(incoming.drop(*FOLDER, "load"), identity)
    if not keep:
        return new.withColumn("batch", F.lit(batch))
    before = landed(spark, table)
    if before is not None:
        before = before.filter((F.col("writer") != writer) | (F.col("batch") != batch))
        if force:
            _evict(spark, table, incoming, (writer, batch))
        else:
            # only the identities of this batch are looked for, so a small batch never shuffles the whole table
            wanted = incoming.select(*identity).distinct()
            seen = before.select(*identity).join(wanted, _same(before, wanted, identity), "left_semi").distinct()
            new = new.join(seen, _same(new, seen, identity), "left_anti")
    load = f"l-{uuid.uuid4().hex}"
    path = f"{table}/records/load={load}"
    new.write.parquet(path)
    log = _read(spark, f"{table}/log")
    version = 0 if log is None else log.where((F.col("writer") == writer) & (F.col("batch") == batch)).count()
    entry = spark.createDataFrame([(writer, batch, version, load)], "writer string, batch int, version long, load string")
    entry.coalesce(1).write.mode("append").parquet(f"{table}/log")
    return spark.read.parquet(path).withColumns({"writer": F.lit(writer), "batch": F.lit(batch)})


def evict(spark: SparkSession, table: str, experiments: DataFrame) -> None:
    """Make the records that these experiments have landed so far no longer count.

    Entries are only ever added; listing an experiment twice changes nothing.
    """
    _evict(spark, table, experiments)


def invalidate(spark: SparkSession, table: str) -> None:
    """Evict everything that has landed so far."""
    records = _read(spark, f"{table}/records")
    if records is not None:
        _evict(spark, table, records)


def _evict(spark: SparkSession, table: str, experiments: DataFrame, but: tuple[str, int] | None = None) -> None:
    """Evict experiments from all loads done so far, but for those of one writer's batch."""
    records, log = _read(spark, f"{table}/records"), _read(spark, f"{table}/log")
    if records is None or log is None:
        return
    if but is not None:
        log = log.where((F.col("writer") != but[0]) | (F.col("batch") != but[1]))
    loads = records.select(ID, "load").join(log.select("load"), "load", "left_semi").distinct()
    gone = loads.join(experiments.select(ID).distinct(), ID, "left_semi")
    gone.write.mode("append").parquet(f"{table}/evicted")


def _once(records: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One of the records that are the same, the first by its JSON text."""
    whole = F.struct(*(F.col(f"`{c}`") for c in records.columns))
    first = F.min_by(whole, F.to_json(whole)).alias("_first")
    return records.groupBy(*identity).agg(first).select("_first.*")


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    test = F.lit(True)
    for name in columns:
        test = test & left[name].eqNullSafe(right[name])
    return test


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
