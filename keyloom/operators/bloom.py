"""Bloom filters: (key, m, k) of each filter and its set bits (key, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import DEFAULT_K, DEFAULT_M, md5_positions_column, murmur_positions_column
from ..schema import Applied

_HASHES = {"murmur": murmur_positions_column, "md5": md5_positions_column}


def reserve(filters: DataFrame, requests: DataFrame) -> Applied:
    """BF.RESERVE over ``requests`` (key, m, k); an existing key replies an error."""
    old = filters.select("key", F.lit("ERR item exists").alias("error"))
    new = requests.join(filters.select("key"), "key", "left_anti").select("key", "m", "k")
    return Applied(filters.unionByName(new), requests.select("key").join(old, "key", "left"))


def _positions(filters: DataFrame, items: DataFrame, hashing: str) -> DataFrame:
    sized = items.join(filters, "key")
    return sized.withColumn("pos", F.explode(_HASHES[hashing](F.col("item"), F.col("m"), F.col("k")))).drop("m", "k")


def add(filters: DataFrame, bits: DataFrame, items: DataFrame, hashing: str = "murmur") -> tuple[DataFrame, DataFrame, DataFrame]:
    """BF.ADD over ``items`` (key, item, seq): the filters, the bits, and 1 per item that set a bit first.

    Filters that do not exist are made with the default size. Items count in the order of ``seq``.
    """
    missing = items.select("key").distinct().join(filters.select("key"), "key", "left_anti").select("key", F.lit(DEFAULT_M).cast("long").alias("m"), F.lit(DEFAULT_K).cast("long").alias("k"))
    made = filters.select("key", F.col("m").cast("long"), F.col("k").cast("long")).unionByName(missing)
    set_ = _positions(made, items, hashing)
    fresh = set_.groupBy("key", "pos").agg(F.min("seq").alias("seq")).join(bits, ["key", "pos"], "left_anti")
    first = fresh.select("key", "seq").distinct().withColumn("added", F.lit(1))
    reply = items.join(first, ["key", "seq"], "left").withColumn("added", F.coalesce("added", F.lit(0)))
    return made, bits.unionByName(fresh.select("key", "pos")), reply


def exists(filters: DataFrame, bits: DataFrame, items: DataFrame, hashing: str = "murmur") -> DataFrame:
    """BF.EXISTS for ``items`` (key, item): 1 if all positions are set, 0 otherwise and without a filter."""
    asked = items.select("key", "item").distinct()
    hits = _positions(filters, asked, hashing).distinct().join(bits.withColumn("__hit", F.lit(1)), ["key", "pos"], "left")
    found = hits.groupBy("key", "item").agg(F.min(F.coalesce("__hit", F.lit(0))).alias("reply"))
    return items.join(found, ["key", "item"], "left").withColumn("reply", F.coalesce("reply", F.lit(0)))
