"""Index ranges, score ranges and glob patterns as column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_bounds(start: int, stop: int, n: Column) -> tuple[Column, Column]:
    """First and last 0-based place of ``start..stop`` in a sequence of ``n``; empty if the first is the larger.

    Negative places count from the end; a start before the sequence is its start, a stop beyond it its end.
    """
    first = F.greatest(F.lit(start) if start >= 0 else n + F.lit(start), F.lit(0))
    last = F.least(F.lit(stop) if stop >= 0 else n + F.lit(stop), n - 1)
    return first, last


#: Ranges that a key's rows are cut into to be ranked: each is sorted by itself.
RANGES = 64


def ranked(rows: DataFrame, by: str, order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """``rows`` (key, ...) with their 0-based rank within the key, and the key's number of rows as ``size`` if asked for.

    A key's rows are cut into ranges of ``by``, the leading column of ``order``, of about equal counts. A rank is the
    number of rows in the ranges before and the place in the own range, so that a key of any size is ranked by
    many tasks. Rows of one value fall in one range.
    """
    cuts = rows.groupBy("key").agg(F.percentile_approx(by, [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
    cut = rows.join(cuts, "key").withColumn("__range", F.expr(f"size(filter(__cuts, c -> c < {by}))")).drop("__cuts")
    sizes = cut.groupBy("key", "__range").agg(F.count("*").alias("__n"))
    of_key = Window.partitionBy("key")
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("__all", F.sum("__n").over(of_key)).drop("__n")
    place = F.row_number().over(Window.partitionBy("key", "__range").orderBy(*order)) - 1
    out = cut.withColumn("__place", place).join(before, ["key", "__range"]).withColumn(name, (F.col("__place") + F.col("__before")).cast("long"))
    out = out.withColumn(size, F.col("__all").cast("long")) if size else out
    return out.drop("__range", "__place", "__before", "__all")


def in_index_range(rows: DataFrame, order: list[Column], start: int, stop: int, keys: tuple[str, ...] = ("key",), place: str = "place", backwards: list[Column] | None = None, by: str | None = None, falling: bool = False) -> DataFrame:
    """Rows of each key at the places ``start..stop`` of its order, with their 0-based ``place``.

    Where both ends count from the front, the rank is limited from above, which Spark applies to each
    task's rows before the shuffle. ``backwards`` is the reverse order; with it, ranges whose ends both
    count from the end are limited in the same way. With ``by``, the leading column of the order, which may be ``falling``,
    others are ranked in ranges of it, and else in one window a key.
    """
    if start >= 0 and stop >= 0:
        if start > stop:
            return rows.withColumn(place, F.lit(0).cast("long")).limit(0)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(place, rank).filter(F.col(place) <= stop + 1).filter(F.col(place) >= start + 1).withColumn(place, (F.col(place) - 1).cast("long"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    if start < 0 and stop < 0 and backwards is not None:
        if start > stop:
            return rows.withColumn(place, F.lit(0).cast("long")).limit(0)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*backwards))
        near = rows.withColumn(place, rank).filter(F.col(place) <= -start).filter(F.col(place) >= -stop)
        return near.join(n, list(keys)).withColumn(place, (F.col("__n") - F.col(place)).cast("long")).drop("__n")
    if by is None:
        whole = rows.withColumn(place, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")).join(n, list(keys))
    else:
        whole = ranked(rows, by, backwards if falling else order, place, "__n")
        whole = whole.withColumn(place, F.col("__n") - 1 - F.col(place)) if falling else whole
    first, last = index_bounds(start, stop, F.col("__n"))
    return whole.filter((F.col(place) >= first) & (F.col(place) <= last)).drop("__n")


@dataclass(frozen=True)
class ScoreRange:
    """Scores between two ends, each inclusive or not. ``parse`` reads ``5``, ``(5``, ``-inf`` and ``+inf``."""

    low: float
    high: float
    low_open: bool = False
    high_open: bool = False

    @classmethod
    def parse(cls, low: str, high: str) -> ScoreRange:
        def end(text: str) -> tuple[float, bool]:
            if text in ("-inf", "+inf"):
                return float(text), False
            opened = text.startswith("(")
            try:
                value = float(text[opened:])
            except ValueError:
                value = math.nan
            if not math.isfinite(value) or re.search("[a-df-zA-DF-Z_]", text):
                raise ValueError("min or max is not a float")
            return value, opened

        (a, ao), (b, bo) = end(low), end(high)
        return cls(a, b, ao, bo)

    def holds(self, score: Column) -> Column:
        low, high = F.lit(self.low), F.lit(self.high)
        return (score > low if self.low_open else score >= low) & (score < high if self.high_open else score <= high)


def glob_to_regex(pattern: str) -> str:
    """``*`` is any run and ``?`` any character; everything else stands for itself. For ``rlike``, anchored."""
    body = "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"([\\.{}()\[\]+^$|])", r"\\\1", c) for c in pattern)
    return f"^(?s:{body})\\z"


def matches_glob(column: Column, pattern: str | None) -> Column:
    return F.lit(True) if pattern in (None, "*") else column.cast("string").rlike(glob_to_regex(pattern))
