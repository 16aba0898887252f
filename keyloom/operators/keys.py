"""Keys and their time to live: DEL, EXISTS, EXPIRE, TTL, PTTL, PERSIST, statistics.

Time is passed as ``now_ms``; a key is gone once ``now_ms`` is beyond its ``expire_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Applied, Keyspace, live

EXPIRE_OPTIONS = (None, "NX", "XX", "GT", "LT")


def delete(keyspace: Keyspace, keys: DataFrame) -> tuple[Keyspace, DataFrame]:
    """DEL: the keyspace without ``keys`` (key), and the number removed; a key named twice counts once."""
    named = keys.select("key").distinct()
    kept = {name: rel.join(named, "key", "left_anti") for name, rel in keyspace.relations().items()}
    return Keyspace(**kept), keyspace.meta.join(named, "key", "left_semi").agg(F.count("*").alias("removed"))


def exists(meta: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """EXISTS: how many of ``keys`` (key) live, each as often as it is named."""
    return keys.select("key").join(live(meta, now_ms).select("key"), "key", "left_semi").agg(F.count("*").alias("found"))


def expire_condition(option: str | None, current: Column, new: Column) -> Column:
    if option not in EXPIRE_OPTIONS:
        raise ValueError(f"unsupported option {option}")
    return {
        None: F.lit(True), "NX": current.isNull(), "XX": current.isNotNull(),
        "GT": current.isNotNull() & (new > current), "LT": current.isNull() | (new < current),
    }[option]


def expire(meta: DataFrame, requests: DataFrame, now_ms: int, option: str | None = None) -> Applied:
    """EXPIRE: ``requests`` (key, seconds), a request per key. Replies 1 where the time was set, else 0."""
    asked = requests.select("key", (F.lit(now_ms) + F.col("seconds").cast("long") * 1000).alias("__new"))
    joined = live(meta, now_ms).join(asked, "key", "left")
    sets = F.col("__new").isNotNull() & expire_condition(option, F.col("expire_at"), F.col("__new"))
    state = joined.withColumn("expire_at", F.when(sets, F.col("__new")).otherwise(F.col("expire_at"))).drop("__new")
    done = joined.filter(sets).select("key", F.lit(1).alias("__done"))
    return Applied(state, asked.select("key").join(done, "key", "left").select("key", F.coalesce("__done", F.lit(0)).alias("reply")))


def pttl(meta: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """PTTL: milliseconds left of each of ``keys``; -1 without an end, -2 for an absent key."""
    alive = live(meta, now_ms).select("key", F.coalesce(F.col("expire_at") - now_ms, F.lit(-1)).alias("pttl"))
    return keys.join(alive, "key", "left").withColumn("pttl", F.coalesce("pttl", F.lit(-2).cast("long")))


def ttl(meta: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """TTL: as PTTL in whole seconds, rounded down."""
    left = pttl(meta, keys, now_ms)
    return left.withColumn("ttl", F.when(F.col("pttl") < 0, F.col("pttl")).otherwise(F.floor(F.col("pttl") / 1000))).drop("pttl")


def persist(meta: DataFrame, keys: DataFrame, now_ms: int) -> Applied:
    """PERSIST: 1 where a time to live was removed."""
    alive = live(meta, now_ms)
    named = keys.select("key").distinct().withColumn("__hit", F.lit(True))
    state = alive.join(named, "key", "left").withColumn("expire_at", F.when(F.col("__hit").isNull(), F.col("expire_at"))).drop("__hit")
    had = alive.filter(F.col("expire_at").isNotNull()).select("key", F.lit(1).alias("__one"))
    return Applied(state, keys.select("key").join(had, "key", "left").select("key", F.coalesce("__one", F.lit(0)).alias("reply")))


def statistics(meta: DataFrame, now_ms: int) -> DataFrame:
    """INFO's keyspace part: keys, and keys with an end, of each type."""
    return live(meta, now_ms).groupBy("type").agg(F.count("*").alias("keys"), F.count("expire_at").alias("expires"))
