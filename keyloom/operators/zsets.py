"""Sorted sets: relations (key, member, score). The order is by score, then by the member's bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import ScoreRange, in_index_range, ranked
from ..schema import Applied

AT = ["key", "member"]


def _up():
    return [F.col("score").asc(), F.col("member").asc()]


def _down():
    return [F.col("score").desc(), F.col("member").desc()]


def _per_key(requests: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    n = hits.groupBy("key").agg(F.count("*").alias(name))
    return requests.select("key").distinct().join(n, "key", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def zadd(zsets: DataFrame, writes: DataFrame) -> Applied:
    """ZADD over ``writes`` (key, member, score, seq), the last score wins; replies the number added per key.

    A score that is null or not a number fails the whole statement.
    """
    score = F.when(F.col("score").isNull() | F.isnan("score"), F.raise_error(F.lit("value is not a valid float"))).otherwise(F.col("score"))
    won = writes.withColumn("score", score.cast("double")).groupBy(*AT).agg(F.max_by("score", "seq").alias("score"))
    new = won.join(zsets.select(*AT), AT, "left_anti")
    return Applied(zsets.join(won.select(*AT), AT, "left_anti").unionByName(won), _per_key(writes, new, "added"))


def zincrby(zsets: DataFrame, deltas: DataFrame) -> Applied:
    """ZINCRBY over ``deltas`` (key, member, delta); replies the new scores."""
    sums = deltas.groupBy(*AT).agg(F.sum("delta").alias("__d"))
    joined = zsets.join(sums, AT, "full").select(*AT, (F.coalesce("score", F.lit(0.0)) + F.coalesce("__d", F.lit(0.0))).alias("score"), F.col("__d").isNotNull().alias("__hit"))
    return Applied(joined.drop("__hit"), joined.filter("__hit").drop("__hit"))


def zscore(zsets: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.join(zsets, AT, "left")


def zcard(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count("*").alias("card"))


def zcount(zsets: DataFrame, keys: DataFrame, within: ScoreRange) -> DataFrame:
    """ZCOUNT for each of ``keys``, 0 where nothing is in the range."""
    return _per_key(keys, zsets.filter(within.holds(F.col("score"))).join(keys.select("key"), "key", "left_semi"), "count")


def zrange(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    """ZRANGE of every key, with the 0-based ``place``."""
    return in_index_range(zsets, _up(), start, stop, backwards=_down(), by="score")


def zrevrange(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    """ZREVRANGE: places count from the highest score."""
    return in_index_range(zsets, _down(), start, stop, backwards=_up(), by="score", falling=True)


def zrangebyscore(zsets: DataFrame, within: ScoreRange, offset: int = 0, count: int = -1) -> DataFrame:
    """ZRANGEBYSCORE with LIMIT; a negative count takes all, a negative offset is an error."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    hits = zsets.filter(within.holds(F.col("score")))
    if count < 0 and offset == 0:
        return hits
    if count >= 0:
        return in_index_range(hits, _up(), offset, offset + count - 1).drop("place") if count else hits.limit(0)
    return in_index_range(hits, _up(), offset, -1, by="score").drop("place")


def zrem(zsets: DataFrame, requests: DataFrame) -> Applied:
    named = requests.select(*AT).distinct()
    return Applied(zsets.join(named, AT, "left_anti"), _per_key(requests, zsets.join(named, AT, "left_semi"), "removed"))


def zremrangebyrank(zsets: DataFrame, start: int, stop: int) -> Applied:
    """ZREMRANGEBYRANK of every key; replies the number removed where any was."""
    gone = zrange(zsets, start, stop).select("key", "member", "score")
    return Applied(zsets.join(gone.select(*AT), AT, "left_anti"), gone.groupBy("key").agg(F.count("*").alias("removed")))


def zremrangebyscore(zsets: DataFrame, within: ScoreRange) -> Applied:
    inside = F.coalesce(within.holds(F.col("score")), F.lit(False))
    return Applied(zsets.filter(~inside), zsets.filter(inside).groupBy("key").agg(F.count("*").alias("removed")))


_FOLD = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def _weighted(zsets: DataFrame, groups: DataFrame, aggregate: str) -> DataFrame:
    if aggregate not in _FOLD:
        raise ValueError("syntax error")
    rows = groups.select("dest", "key", "weight").join(zsets, "key")
    return rows.groupBy("dest", "member").agg(_FOLD[aggregate](F.col("score") * F.col("weight")).alias("score"), F.count("*").alias("__have"))


def zunion(zsets: DataFrame, groups: DataFrame, aggregate: str = "SUM") -> DataFrame:
    """ZUNIONSTORE's result over ``groups`` (dest, key, weight): scores times weights, then aggregated."""
    return _weighted(zsets, groups, aggregate).drop("__have")


def zinter(zsets: DataFrame, groups: DataFrame, aggregate: str = "SUM") -> DataFrame:
    """ZINTERSTORE's result: members that every source has; an absent source empties it."""
    wanted = groups.groupBy("dest").agg(F.count("*").alias("__n"))
    return _weighted(zsets, groups, aggregate).join(wanted, "dest").filter("__have = __n").drop("__have", "__n")


def store(zsets: DataFrame, result: DataFrame, groups: DataFrame) -> Applied:
    """``result`` (dest, member, score) takes the place of each dest, which goes if it is empty; replies sizes."""
    dests = groups.select(F.col("dest").alias("key")).distinct()
    new = result.select(F.col("dest").alias("key"), "member", "score")
    return Applied(zsets.join(dests, "key", "left_anti").unionByName(new), _per_key(dests, new, "size"))


def zrank(zsets: DataFrame, reverse: bool = False) -> DataFrame:
    """The 0-based rank of every member."""
    if not reverse:
        return ranked(zsets, "score", _up(), "rank")
    return ranked(zsets, "score", _up(), "rank", "__size").withColumn("rank", F.col("__size") - 1 - F.col("rank")).drop("__size")


def zrank_of(zsets: DataFrame, requests: DataFrame) -> DataFrame:
    """ZRANK of ``requests`` (key, member), few or all: null for no member. Only the keys asked for are ranked."""
    held = zsets.join(requests.select("key").distinct(), "key", "left_semi")
    return requests.join(zrank(held).select(*AT, "rank"), AT, "left")
