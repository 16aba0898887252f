"""Hashes: relations (key, field, value); writes carry ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Applied
from . import strings

AT = ["key", "field"]


def hset(hashes: DataFrame, writes: DataFrame) -> Applied:
    """HSET over ``writes`` (key, field, value, seq); replies the number of new fields per key."""
    won = writes.groupBy(*AT).agg(F.max_by("value", "seq").alias("value"))
    new = won.join(hashes.select(*AT), AT, "left_anti").groupBy("key").agg(F.count("*").alias("added"))
    reply = writes.select("key").distinct().join(new, "key", "left").withColumn("added", F.coalesce("added", F.lit(0).cast("long")))
    return Applied(hashes.join(won.select(*AT), AT, "left_anti").unionByName(won), reply)


def hget(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """HGET: ``requests`` (key, field) with values, null where absent."""
    return requests.join(hashes, AT, "left")


def hmget(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """HMGET: ``requests`` (key, pos, field) with values."""
    return requests.join(hashes, AT, "left").select("key", "pos", "field", "value")


def hgetall(hashes: DataFrame, keys: DataFrame) -> DataFrame:
    """HGETALL: every field and value of ``keys``, a row each."""
    return hashes.join(keys.select("key"), "key", "left_semi")


def hdel(hashes: DataFrame, requests: DataFrame) -> Applied:
    """HDEL over ``requests`` (key, field); replies the number removed per key."""
    named = requests.select(*AT).distinct()
    gone = hashes.join(named, AT, "left_semi").groupBy("key").agg(F.count("*").alias("removed"))
    reply = requests.select("key").distinct().join(gone, "key", "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))
    return Applied(hashes.join(named, AT, "left_anti"), reply)


def hlen(hashes: DataFrame) -> DataFrame:
    """HLEN of every key."""
    return hashes.groupBy("key").agg(F.count("*").alias("length"))


def hexists(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """HEXISTS: 1 or 0 for ``requests`` (key, field)."""
    return requests.join(hashes.select(*AT, F.lit(1).alias("reply")), AT, "left").withColumn("reply", F.coalesce("reply", F.lit(0)))


def hincrby(hashes: DataFrame, deltas: DataFrame) -> Applied:
    """HINCRBY over ``deltas`` (key, field, delta), as the counters of strings; the pair is the counter's name."""
    def paired(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.struct(*AT)).drop("field")

    state, reply = strings.incr_by(paired(hashes), paired(deltas))

    def parted(df: DataFrame) -> DataFrame:
        return df.select("key.key", "key.field", *[c for c in df.columns if c != "key"])

    return Applied(parted(state), parted(reply))


def hkeys(hashes: DataFrame) -> DataFrame:
    """HKEYS, without a cap."""
    return hashes.select(*AT)


def hvals(hashes: DataFrame) -> DataFrame:
    """HVALS, without a cap."""
    return hashes.select("key", "value")
