"""Scores as text: whole ones without a fraction, others as the shortest text that reads back the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers up to here stand without a fraction; beyond, a double no longer tells neighbours apart.
WHOLE = float(1 << 53)


def score_text(score: Column) -> Column:
    """The reply's form of a score; infinities are ``inf`` and ``-inf``."""
    whole = (score % 1 == 0) & (F.abs(score) <= WHOLE)
    return F.when(score == float("inf"), "inf").when(score == float("-inf"), "-inf").when(whole, score.cast("bigint").cast("string")).otherwise(score.cast("string"))
