"""Strings and counters. Relations (key, value); writes carry ``seq``, which orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NOT_INTEGER, Applied

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def get(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """GET: the value of each of ``keys``, null where there is none."""
    return keys.join(strings, "key", "left")


def mget(strings: DataFrame, requests: DataFrame) -> DataFrame:
    """MGET: ``requests`` (pos, key) with values; absent keys and those of other types are null."""
    return requests.join(strings, "key", "left").select("pos", "key", "value")


def set_values(strings: DataFrame, writes: DataFrame, condition: str | None = None) -> Applied:
    """SET over ``writes`` (key, value, seq): the last write of a key wins.

    NX writes only absent keys, where the first write wins; XX only present ones. Replies OK or null per
    key. Values of any former type give way, which is why ``strings`` needs no check.
    """
    if condition not in (None, "NX", "XX"):
        raise ValueError("syntax error")
    pick = F.min_by if condition == "NX" else F.max_by
    won = writes.groupBy("key").agg(pick("value", "seq").alias("value"))
    if condition:
        how = "left_anti" if condition == "NX" else "left_semi"
        won, asked = won.join(strings.select("key"), "key", how), won.select("key")
    else:
        asked = won.select("key")
    state = strings.join(won.select("key"), "key", "left_anti").unionByName(won)
    reply = asked.join(won.select("key", F.lit("OK").alias("reply")), "key", "left")
    return Applied(state, reply)


def setnx(strings: DataFrame, meta: DataFrame, writes: DataFrame) -> Applied:
    """SETNX: 1 where the key, of whatever type, was absent."""
    first = writes.groupBy("key").agg(F.min_by("value", "seq").alias("value"))
    new = first.join(meta.select("key"), "key", "left_anti")
    reply = first.select("key").join(new.select("key", F.lit(1).alias("reply")), "key", "left").withColumn("reply", F.coalesce("reply", F.lit(0)))
    return Applied(strings.unionByName(new), reply)


def mset(strings: DataFrame, writes: DataFrame) -> Applied:
    """MSET: as SET, argument positions in ``seq``; a single OK."""
    return set_values(strings, writes)


def getex(strings: DataFrame, meta: DataFrame, requests: DataFrame, now_ms: int) -> Applied:
    """GETEX over ``requests`` (key, expire_at, persist): the value, then its new end.

    A null ``expire_at`` without ``persist`` changes nothing. An end in the past removes the key, and the
    reply is still the old value. The state is ``meta`` afterwards.
    """
    reply = requests.select("key").join(strings, "key", "left")
    hit = requests.select("key", F.col("expire_at").alias("__new"), "persist").join(strings.select("key"), "key", "left_semi")
    after = meta.join(hit, "key", "left").withColumn("expire_at", F.when(F.coalesce("persist", F.lit(False)), None).otherwise(F.coalesce("__new", "expire_at")))
    return Applied(after.filter(F.col("expire_at").isNull() | (F.col("expire_at") >= now_ms)).drop("__new", "persist"), reply)


def append(strings: DataFrame, writes: DataFrame) -> Applied:
    """APPEND over ``writes`` (key, value, seq) in their order; replies the new length in bytes."""
    added = writes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("parts"))
    tail = F.aggregate("parts", F.lit("").cast(writes.schema["value"].dataType), lambda a, p: F.concat(a, p["value"]))
    tails = added.select("key", tail.alias("__tail"))
    joined = strings.join(tails, "key", "full").select("key", F.when(F.col("__tail").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("__tail")).otherwise(F.concat("value", "__tail")).alias("value"), F.col("__tail").isNotNull().alias("__hit"))
    return Applied(joined.drop("__hit"), joined.filter("__hit").select("key", F.octet_length("value").alias("length")))


def strlen(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """STRLEN: bytes of each of ``keys``, 0 where absent."""
    return get(strings, keys).select("key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("length"))


def incr_by(strings: DataFrame, deltas: DataFrame) -> Applied:
    """INCR, INCRBY, DECR, DECRBY over ``deltas`` (key, delta): absent counts as 0.

    Sums add up in tasks before the shuffle. Replies (key, value, error); text that is no 64-bit integer,
    or a sum beyond 64 bits, is an error and leaves the value as it is.
    """
    wide = "decimal(38,0)"
    sums = deltas.groupBy("key").agg(F.sum(F.col("delta").cast(wide)).alias("__sum"))
    text = F.col("value").cast("string")
    number = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text).try_cast("long")
    joined = strings.join(sums, "key", "full").withColumn("__old", F.when(F.col("value").isNull(), F.lit(0)).otherwise(number)).withColumn("__new", F.col("__old").cast(wide) + F.col("__sum"))
    fine = F.col("__new").between(F.lit(_LOW).cast(wide), F.lit(_HIGH).cast(wide))
    new = F.when(F.col("__sum").isNotNull() & F.coalesce(fine, F.lit(False)), F.col("__new").cast("long"))
    out = joined.select("key", "value", "__sum", new.alias("__set"))
    state = out.select("key", F.coalesce(F.col("__set").cast("string").cast(strings.schema["value"].dataType), F.col("value")).alias("value"))
    reply = out.filter(F.col("__sum").isNotNull()).select("key", F.col("__set").alias("value"), F.when(F.col("__set").isNull(), NOT_INTEGER).alias("error"))
    return Applied(state, reply)
