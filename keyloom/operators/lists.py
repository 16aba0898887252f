"""Lists: relations (key, pos, value). Order is by ``pos``, which may have gaps; pushes never renumber."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import in_index_range
from ..schema import Applied

AT = ["key", "pos"]


def _up():
    return [F.col("pos").asc()]


def _down():
    return [F.col("pos").desc()]


def push(lists: DataFrame, writes: DataFrame, left: bool = False, only_existing: bool = False) -> Applied:
    """LPUSH, RPUSH and their X forms over ``writes`` (key, value, seq), each pushed in turn.

    New positions follow from ``seq`` and the list's end, so that no list is sorted. Replies lengths; with
    ``only_existing`` absent keys stay absent and reply 0.
    """
    ends = lists.groupBy("key").agg(F.min("pos").alias("__low"), F.max("pos").alias("__high"), F.count("*").alias("__n"))
    firsts = writes.groupBy("key").agg(F.min("seq").alias("__seq"), F.count("*").alias("__m"))
    at = firsts.join(ends, "key", "inner" if only_existing else "left")
    step = F.col("seq") - F.col("__seq") + 1
    pos = F.coalesce("__low", F.lit(0).cast("long")) - step if left else F.coalesce("__high", F.lit(-1).cast("long")) + step
    new = writes.join(at, "key").select("key", pos.cast("long").alias("pos"), "value")
    length = at.select("key", (F.coalesce("__n", F.lit(0).cast("long")) + F.col("__m")).alias("length"))
    reply = firsts.select("key").join(length, "key", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    return Applied(lists.unionByName(new), reply)


def pop(lists: DataFrame, count: int = 1, left: bool = True) -> Applied:
    """LPOP, RPOP of every key; replies (key, place, value), place 0 being popped first."""
    if count < 0:
        raise ValueError("value is out of range, must be positive")
    if not count:
        return Applied(lists, lists.withColumn("place", F.lit(0).cast("long")).limit(0).select("key", "place", "value"))
    out = in_index_range(lists, _up() if left else _down(), 0, count - 1)
    return Applied(lists.join(out.select(*AT), AT, "left_anti"), out.select("key", "place", "value"))


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("length"))


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE of every key -> (key, pos, value, place)."""
    return in_index_range(lists, _up(), start, stop, backwards=_down(), by="pos")


def lindex(lists: DataFrame, index: int, keys: DataFrame | None = None) -> DataFrame:
    """LINDEX: the value at ``index`` of every key, or of ``keys``, where it is null out of range."""
    hit = lrange(lists, index, index).select("key", "value")
    return hit if keys is None else keys.join(hit, "key", "left")


def lset(lists: DataFrame, requests: DataFrame, index: int) -> Applied:
    """LSET at ``index`` over ``requests`` (key, value); replies OK, or the error in ``error``."""
    hit = lrange(lists.join(requests.select("key"), "key", "left_semi"), index, index).select(*AT)
    new = hit.join(requests.select("key", F.col("value").alias("__v")), "key").withColumn("__hit", F.lit(True))
    state = lists.join(new, AT, "left").withColumn("value", F.when(F.col("__hit").isNull(), F.col("value")).otherwise(F.col("__v"))).drop("__v", "__hit")
    known = llen(lists).select("key", F.lit(True).alias("__known"))
    told = requests.select("key").join(known, "key", "left").join(hit.select("key", F.lit("OK").alias("reply")), "key", "left")
    error = F.when(F.col("__known").isNull(), "ERR no such key").when(F.col("reply").isNull(), "ERR index out of range")
    return Applied(state, told.select("key", "reply", error.alias("error")))


def linsert(lists: DataFrame, requests: DataFrame, before: bool = True) -> Applied:
    """LINSERT over ``requests`` (key, pivot, value): at the first pivot from the head.

    What stands behind moves by one; nothing is sorted. Replies the new length, -1 without the pivot, 0
    for an absent key.
    """
    asked = requests.select("key", "pivot", F.col("value").alias("__v"))
    at = lists.join(asked, "key").filter(F.col("value") == F.col("pivot")).groupBy("key").agg(F.min("pos").alias("__p"), F.first("__v").alias("__v"))
    behind = F.col("pos") >= F.col("__p") if before else F.col("pos") > F.col("__p")
    moved = lists.join(at.select("key", "__p"), "key", "left").select("key", (F.col("pos") + F.coalesce(behind, F.lit(False)).cast("long")).alias("pos"), "value")
    new = at.select("key", (F.col("__p") + (0 if before else 1)).alias("pos"), F.col("__v").alias("value"))
    told = asked.select("key").join(llen(lists), "key", "left").join(at.select("key", "__p"), "key", "left")
    length = F.when(F.col("length").isNull(), 0).when(F.col("__p").isNull(), -1).otherwise(F.col("length") + 1)
    return Applied(moved.unionByName(new), told.select("key", length.cast("long").alias("length")))


def lrem(lists: DataFrame, requests: DataFrame, count: int = 0) -> Applied:
    """LREM over ``requests`` (key, value): ``count`` from the head, from the tail if negative, all if 0."""
    named = requests.select("key", "value").distinct()
    hits = lists.join(named, ["key", "value"], "left_semi")
    if count:
        rank = F.row_number().over(Window.partitionBy("key", "value").orderBy(*(_up() if count > 0 else _down())))
        hits = hits.withColumn("__rank", rank).filter(F.col("__rank") <= abs(count)).drop("__rank")
    n = hits.groupBy("key").agg(F.count("*").alias("removed"))
    reply = requests.select("key").distinct().join(n, "key", "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))
    return Applied(lists.join(hits.select(*AT), AT, "left_anti"), reply)


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM of every key: what LRANGE gives stays."""
    return lrange(lists, start, stop).drop("place")


def blocking_match(items: DataFrame, waiters: DataFrame, from_left: bool = True) -> DataFrame:
    """BLPOP, BRPOP without timeouts: the r-th waiter of a key gets its r-th item.

    ``waiters`` (key, wait_seq). Waiters left over come out with null values, and wait on.
    """
    wk = Window.partitionBy("key")
    w = waiters.withColumn("__r", F.row_number().over(wk.orderBy("wait_seq")))
    i = items.withColumn("__r", F.row_number().over(wk.orderBy(*(_up() if from_left else _down()))))
    return w.join(i, ["key", "__r"], "left").select("key", "wait_seq", "pos", "value")


def first_of(lists: DataFrame, requests: DataFrame, from_left: bool = True) -> DataFrame:
    """BLPOP over several keys: for ``requests`` (request, ord, key) the first key in order that has an item."""
    heads = lrange(lists, 0, 0) if from_left else lrange(lists, -1, -1)
    found = requests.join(heads.select("key", "value"), "key")
    return found.groupBy("request").agg(F.min_by(F.struct("key", "value"), "ord").alias("__got")).select("request", "__got.key", "__got.value")


def rpoplpush(lists: DataFrame, moves: DataFrame) -> Applied:
    """BRPOPLPUSH over ``moves`` (src, dest, seq): tails of src go before the head of dest, in turn.

    The r-th move of a src takes its r-th element from the tail; moves that find none wait (null reply).
    """
    ranked = moves.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy("seq")))
    most = ranked.groupBy(F.col("src").alias("key")).agg(F.max("__r").alias("__most"))
    tails = lists.join(most, "key").withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(*_down()))).filter("__r <= __most")
    got = ranked.join(tails.select(F.col("key").alias("src"), "__r", "pos", "value"), ["src", "__r"], "left")
    done = got.filter(F.col("pos").isNotNull())
    left = lists.join(done.select(F.col("src").alias("key"), "pos"), AT, "left_anti")
    state = push(left, done.select(F.col("dest").alias("key"), "value", "seq"), left=True).state
    return Applied(state, got.select("seq", "src", "dest", "value"))
