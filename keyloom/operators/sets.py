"""Sets: relations (key, member), distinct. Groups (dest, key) name the sources of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Applied

AT = ["key", "member"]


def _counted(requests: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    n = hits.groupBy("key").agg(F.count("*").alias(name))
    return requests.select("key").distinct().join(n, "key", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def sadd(sets: DataFrame, writes: DataFrame) -> Applied:
    """SADD over ``writes`` (key, member); replies the number newly added per key."""
    new = writes.select(*AT).distinct().join(sets, AT, "left_anti")
    return Applied(sets.unionByName(new), _counted(writes, new, "added"))


def srem(sets: DataFrame, writes: DataFrame) -> Applied:
    """SREM; replies the number removed per key."""
    named = writes.select(*AT).distinct()
    return Applied(sets.join(named, AT, "left_anti"), _counted(writes, sets.join(named, AT, "left_semi"), "removed"))


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count("*").alias("card"))


def scard_approx(sets: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Cardinality of bags, by a sketch that merges before the shuffle."""
    return sets.groupBy("key").agg(F.approx_count_distinct("member", rsd).alias("card"))


def sismember(sets: DataFrame, requests: DataFrame) -> DataFrame:
    """SISMEMBER: 1 or 0 for ``requests`` (key, member)."""
    return requests.join(sets.select(*AT, F.lit(1).alias("reply")), AT, "left").withColumn("reply", F.coalesce("reply", F.lit(0)))


def smembers(sets: DataFrame, keys: DataFrame) -> DataFrame:
    return sets.join(keys.select("key"), "key", "left_semi")


def sunion(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """SUNION of the sets that ``groups`` (dest, key) name -> (dest, member)."""
    return groups.select("dest", "key").join(sets, "key").select("dest", "member").distinct()


def sinter(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """SINTER: members that all of a group's sets have; an absent set empties the result."""
    named = groups.select("dest", "key").distinct()
    wanted = named.groupBy("dest").agg(F.count("*").alias("__n"))
    have = named.join(sets, "key").groupBy("dest", "member").agg(F.count("*").alias("__have"))
    return have.join(wanted, "dest").filter("__have = __n").select("dest", "member")


def sdiff(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """SDIFF over ``groups`` (dest, key, ord): members of the set of the least ``ord`` that no other has."""
    first = groups.groupBy("dest").agg(F.min_by("key", "ord").alias("key"), F.min("ord").alias("__first"))
    rest = groups.join(first.select("dest", "__first"), "dest").filter("ord > __first").select("dest", "key")
    return first.select("dest", "key").join(sets, "key").select("dest", "member").join(sunion(sets, rest), ["dest", "member"], "left_anti")


def sintercard(sets: DataFrame, groups: DataFrame, limit: int = 0) -> DataFrame:
    """SINTERCARD: the intersection's size, counted up to ``limit`` if that is above 0."""
    n = sinter(sets, groups).groupBy("dest").agg(F.count("*").alias("card"))
    out = groups.select("dest").distinct().join(n, "dest", "left").withColumn("card", F.coalesce("card", F.lit(0).cast("long")))
    return out.withColumn("card", F.least("card", F.lit(limit).cast("long"))) if limit > 0 else out


def store(sets: DataFrame, result: DataFrame) -> DataFrame:
    """The *STORE forms: ``result`` (dest, member) takes the place of whatever ``dest`` held."""
    new = result.select(F.col("dest").alias("key"), "member")
    return sets.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def smove(sets: DataFrame, moves: DataFrame) -> Applied:
    """SMOVE over ``moves`` (src, dest, member), each pair of src and member once; 0 where src lacks the member."""
    there = moves.join(sets.select(F.col("key").alias("src"), "member"), ["src", "member"], "left_semi")
    left = sets.join(there.select(F.col("src").alias("key"), "member"), AT, "left_anti")
    reply = moves.join(there.select("src", "dest", "member", F.lit(1).alias("reply")), ["src", "dest", "member"], "left").withColumn("reply", F.coalesce("reply", F.lit(0)))
    return Applied(left.unionByName(there.select(F.col("dest").alias("key"), "member")).distinct(), reply)


def _shuffled(sets: DataFrame, seed: int, count: int) -> DataFrame:
    """The first ``count`` members of each key in an order drawn by ``seed``, the same in any run and engine."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("key"), F.col("member").cast("string")))
    return sets.withColumn("__rank", F.row_number().over(Window.partitionBy("key").orderBy(order, "member"))).filter(F.col("__rank") <= count).drop("__rank")


def spop(sets: DataFrame, count: int = 1, seed: int = 0) -> Applied:
    """SPOP: ``count`` members of each key, drawn without replacement, leave it."""
    if count < 0:
        raise ValueError("value is out of range, must be positive")
    out = _shuffled(sets, seed, count)
    return Applied(sets.join(out, AT, "left_anti"), out)


def srandmember(sets: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """SRANDMEMBER: distinct members for a positive count; for a negative one, draws that may repeat."""
    if count >= 0:
        return _shuffled(sets, seed, count)
    n = sets.groupBy("key").agg(F.count("*").alias("__n"))
    ranked = sets.withColumn("__rank", F.row_number().over(Window.partitionBy("key").orderBy("member")) - 1)
    draws = n.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-count)))).withColumn("__rank", F.expr(f"cast(pmod(xxhash64(key, draw, {seed}), __n) as int)"))
    return draws.join(ranked, ["key", "__rank"]).select("key", "member")
