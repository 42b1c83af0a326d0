"""Blocks of documents that share one dictionary of what has to be looked up for them.

A document's keys (words, pairs of token ids) need values that only the whole corpus knows. A row for every document
and key would be many times the text, so a task cuts its documents into blocks, lists each key of a block once, and
keeps a document's keys as places in that list. The lists meet the corpus' values in a join by key; a frequent key is
there once per block, so no key gathers rows. The values then come back to their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2 << 20  # bytes of text of a block; a longer text is a block by itself


def numbers() -> Iterator[int]:
    """Numbers of the blocks of this task; a task that runs again gives the same ones."""
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def cut(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``size`` bytes in a column, and one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        low = total = 0
        for high, n in enumerate(lengths.to_pylist()):
            if total and total + n > size:
                yield batch.slice(low, high - low)
                low, total = high, 0
            total += n
        if low < len(lengths):
            yield batch.slice(low)


def lists(arrays: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per entry of ``ends``, which says where its values end."""
    starts = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(arrays, kind))


def totals(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of the values of each list, given the lists' lengths."""
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(lengths)
    return running[ends] - running[ends - lengths]


def dictionary(written: DataFrame, *columns: str) -> DataFrame:
    """(block, place, columns...) of the blocks' lists: parallel arrays, null in rows that are documents."""
    listed = written.where(F.col(columns[0]).isNotNull()).select("block", F.posexplode(F.arrays_zip(*columns)))
    return listed.select("block", F.col("pos").alias("place"), *(F.col("col")[c].alias(c) for c in columns))


def give_back(documents: DataFrame, values: DataFrame, work, schema: str) -> DataFrame:
    """Call ``work(documents, values)`` for every block with Arrow tables; values are sorted by place."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right.sort_by("place"))

    # renamed, as both sides come from one written table
    documents, values = documents.withColumn("_mine", F.col("block")), values.withColumnRenamed("block", "_theirs")
    return documents.groupBy("_mine").cogroup(values.groupBy("_theirs")).applyInArrow(both, schema)
