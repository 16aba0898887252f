"""Cursor scans: a page is COUNT rows from the cursor; the pattern filters the page, not the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import in_index_range, matches_glob


def page(rows: DataFrame, order: list[Column], name: str, cursor: int = 0, count: int = 10, pattern: str | None = None, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """One page of every key, with ``next_cursor``, 0 at the end. A count below 1 is 10, a cursor below 0 is 0."""
    count, cursor = count if count >= 1 else 10, max(cursor, 0)
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    got = in_index_range(rows, order, cursor, cursor + count - 1, keys).drop("place")
    after = F.when(F.col("__n") > cursor + count, F.lit(cursor + count)).otherwise(0).cast("long")
    return got.filter(matches_glob(F.col(name), pattern)).join(n, list(keys)).withColumn("next_cursor", after).drop("__n")


def sscan(sets: DataFrame, cursor: int = 0, count: int = 10, pattern: str | None = None) -> DataFrame:
    return page(sets, [F.col("member")], "member", cursor, count, pattern)


def hscan(hashes: DataFrame, cursor: int = 0, count: int = 10, pattern: str | None = None) -> DataFrame:
    return page(hashes, [F.col("field")], "field", cursor, count, pattern)


def zscan(zsets: DataFrame, cursor: int = 0, count: int = 10, pattern: str | None = None) -> DataFrame:
    """By rank, always with scores."""
    return page(zsets, [F.col("score"), F.col("member")], "member", cursor, count, pattern)


def scan(meta: DataFrame, after: str | None = None, count: int = 10, pattern: str | None = None) -> DataFrame:
    """SCAN of the keyspace: ``count`` keys beyond the key ``after``, read by a filter that Parquet prunes by."""
    rows = meta if after is None else meta.filter(F.col("key") > after)
    return rows.orderBy("key").limit(count if count >= 1 else 10).filter(matches_glob(F.col("key"), pattern))
