"""Newest record per key.

All forms reduce every key to one row per input task before the shuffle, so a key that holds a
large share of the records moves no more rows than there are input tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# An integer tie-break spans less than 2e19, so timestamp * 2e19 + tie-break keeps their order.
TIE_SPAN = "20000000000000000000"


def newest(records: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole record per key: the first in ``order``, which must be total.

    Catalyst plans ``row_number() = 1`` as a group limit on both sides of the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        records.withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")
    )


def newest_values(
    records: DataFrame, keys: Sequence[str], rank: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """``keys, values`` of the record with the largest ``rank``; nulls rank lowest.

    For a few narrow values and an order that is descending throughout: input tasks sort by the keys
    only, not by the order as well. The rank must be total.
    """
    best = F.max(F.struct(*rank, *(v for v in values if v not in rank))).alias("_best")
    return records.groupBy(*keys).agg(best).select(*keys, *(F.col("_best")[v].alias(v) for v in values))


def newest_score(
    records: DataFrame, keys: Sequence[str], score: Column, ts: Column, tiebreak: Column
) -> DataFrame:
    """``keys, score`` of the newest record, when only a number is wanted.

    Timestamp and integer tie-break are packed into one decimal: every buffer of the aggregate is
    then fixed-width, and Spark plans a hash aggregate without any sort. A null timestamp is older
    than any other. The tie-break must be unique among equal timestamps of a key.
    """
    micros = _micros(records, ts).cast("decimal(18,0)")
    oldest = F.lit("-" + "9" * 18).cast("decimal(18,0)")
    packed = F.coalesce(micros, oldest) * F.lit(TIE_SPAN).cast("decimal(20,0)") + tiebreak.cast(
        "decimal(19,0)"
    )
    return records.groupBy(*keys).agg(F.max_by(score.cast("double"), packed).alias("score"))


def _micros(records: DataFrame, ts: Column) -> Column:
    """Microseconds that order like the timestamps.

    A timestamp without a zone is taken apart by its calendar fields: casting it to an instant would
    depend on the session's zone, and reorder it around clock changes.
    """
    if not isinstance(records.select(ts).schema[0].dataType, TimestampNTZType):
        return F.unix_micros(ts.cast("timestamp"))
    seconds = F.unix_date(ts.cast("date")) * F.lit(86400).cast("bigint") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
