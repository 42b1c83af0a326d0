"""Text columns as numpy arrays inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 512  # rows per Arrow batch, so that a batch of long texts fits


def small_batches(df: DataFrame) -> None:
    """Keep Arrow batches small for the session: texts have no bound on their length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with A-Z in lower case, and where each text starts (one more at the end)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5), offsets - offsets[0]
