"""Text forms of scores, for sinks only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_text(score: Column) -> Column:
    """Score as a percentage with two decimals, ``-`` when missing.

    ``format_string`` rounds the printed decimal half up; a value exactly on a half may differ
    in the last digit from tools that round the binary value.
    """
    return F.coalesce(F.when(score.isNotNull(), F.format_string("%.2f", score * 100)), F.lit("-"))
