"""Commands by name over a whole keyspace: type checks, metadata upkeep, and the operator behind each name.

``read`` and ``write`` take a batch of requests for many keys at once. Requests to keys of another type
come back as errors and have no effect; a container that becomes empty loses its key; a new container has
no end. SET, MSET, BITOP's and the *STORE commands' destinations take over keys of any type. Bitmaps and
Bloom filters are strings; the commands on them open those of the keys asked for, and no others.

``run`` takes any command; ``names`` lists them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bitmaps, bloom, dense, hashes, keys, lists, scan, sets, strings, zsets
from ..schema import Keyspace
from ..sources.staging import stage

RELATION = dict(Keyspace.TYPES)

#: Command: (type of its keys, operator on that type's relation and further arguments).
READS: dict[str, tuple[str, Callable]] = {
    "GET": ("STRING", strings.get), "MGET": ("STRING", strings.mget), "STRLEN": ("STRING", strings.strlen),
    "HGET": ("HASH", hashes.hget), "HMGET": ("HASH", hashes.hmget), "HGETALL": ("HASH", hashes.hgetall), "HLEN": ("HASH", hashes.hlen), "HEXISTS": ("HASH", hashes.hexists),
    "HKEYS": ("HASH", hashes.hkeys), "HVALS": ("HASH", hashes.hvals), "HSCAN": ("HASH", scan.hscan),
    "LLEN": ("LIST", lists.llen), "LINDEX": ("LIST", lists.lindex), "LRANGE": ("LIST", lists.lrange),
    "SCARD": ("SET", sets.scard), "SISMEMBER": ("SET", sets.sismember), "SMEMBERS": ("SET", sets.smembers), "SUNION": ("SET", sets.sunion), "SINTER": ("SET", sets.sinter),
    "SDIFF": ("SET", sets.sdiff), "SINTERCARD": ("SET", sets.sintercard), "SRANDMEMBER": ("SET", sets.srandmember), "SSCAN": ("SET", scan.sscan),
    "ZSCORE": ("ZSET", zsets.zscore), "ZCARD": ("ZSET", zsets.zcard), "ZCOUNT": ("ZSET", zsets.zcount), "ZRANGE": ("ZSET", zsets.zrange), "ZREVRANGE": ("ZSET", zsets.zrevrange),
    "ZRANGEBYSCORE": ("ZSET", zsets.zrangebyscore), "ZRANK": ("ZSET", zsets.zrank), "ZSCAN": ("ZSET", scan.zscan),
}
WRITES: dict[str, tuple[str, Callable]] = {
    "SET": ("STRING", strings.set_values), "MSET": ("STRING", strings.mset), "APPEND": ("STRING", strings.append), "INCRBY": ("STRING", strings.incr_by),
    "HSET": ("HASH", hashes.hset), "HDEL": ("HASH", hashes.hdel), "HINCRBY": ("HASH", hashes.hincrby),
    "LPUSH": ("LIST", lambda r, w: lists.push(r, w, left=True)), "RPUSH": ("LIST", lists.push), "LPUSHX": ("LIST", lambda r, w: lists.push(r, w, True, True)), "RPUSHX": ("LIST", lambda r, w: lists.push(r, w, False, True)),
    "LSET": ("LIST", lists.lset), "LINSERT": ("LIST", lists.linsert), "LREM": ("LIST", lists.lrem),
    "SADD": ("SET", sets.sadd), "SREM": ("SET", sets.srem), "ZADD": ("ZSET", zsets.zadd), "ZINCRBY": ("ZSET", zsets.zincrby), "ZREM": ("ZSET", zsets.zrem),
}
#: Commands that act on every key of their type.
SWEEPS: dict[str, tuple[str, Callable]] = {
    "LPOP": ("LIST", lists.pop), "RPOP": ("LIST", lambda r, count=1: lists.pop(r, count, left=False)), "SPOP": ("SET", sets.spop),
    "ZREMRANGEBYRANK": ("ZSET", zsets.zremrangebyrank), "ZREMRANGEBYSCORE": ("ZSET", zsets.zremrangebyscore),
}
OVERWRITES = ("SET", "MSET")


def _step(n: int):
    """INCR, DECR: a step for each request."""
    return lambda r, w: strings.incr_by(r, w.select("key", F.lit(n).cast("long").alias("delta")))


WRITES |= {
    "INCR": ("STRING", _step(1)), "DECR": ("STRING", _step(-1)), "DECRBY": ("STRING", lambda r, w: strings.incr_by(r, w.select("key", (-F.col("delta")).alias("delta")))),
}


class Outcome(NamedTuple):
    keyspace: Keyspace
    reply: DataFrame
    errors: DataFrame | None


def read(ks: Keyspace, command: str, *args, now_ms: int | None = None, **options) -> DataFrame:
    """The replies of a reading command; a DataFrame of requests, if it takes one, comes first in ``args``."""
    kind, op = READS[command.upper()]
    live = ks if now_ms is None else ks.live(now_ms)
    return op(getattr(live, RELATION[kind]), *args, **options)


def _settled(ks: Keyspace, kind: str, state: DataFrame) -> Keyspace:
    """``ks`` with a relation replaced and its keys' metadata following it."""
    # Spark 4.1 zips the sides of a union by partition if both are dealt by key, and fails where a side's number changes at run time.
    ks.meta.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    ends = ks.meta.select("key", "expire_at")
    own = state.select("key").distinct().join(ends, "key", "left").select("key", F.lit(kind).alias("type"), "expire_at")
    others = ks.meta.filter(F.col("type") != kind).join(own.select("key"), "key", "left_anti")
    return ks.with_(meta=others.unionByName(own), **{RELATION[kind]: state})


def _overwritten(ks: Keyspace, requests: DataFrame, condition: str | None = None) -> Outcome:
    """SET and MSET over ``requests`` (key, value, seq): whatever the keys held goes, and their ends with it.

    NX writes keys that hold nothing, where the first write wins, XX those that hold anything. A column
    ``expire_at`` of the winning write, where it is not null, is the key's new end.
    """
    if condition not in (None, "NX", "XX"):
        raise ValueError("syntax error")
    chosen = requests if condition is None else requests.join(ks.meta.select("key"), "key", "left_anti" if condition == "NX" else "left_semi")
    pick = F.min_by if condition == "NX" else F.max_by
    columns = ["value", *(c for c in requests.columns if c == "expire_at")]
    won = chosen.groupBy("key").agg(*(pick(F.struct(F.col(c)), "seq").alias(c) for c in columns)).select("key", *(F.col(f"{c}.{c}").alias(c) for c in columns))
    left = ks.without(won.select("key"))
    end = F.col("expire_at").cast("bigint") if "expire_at" in columns else F.lit(None).cast("bigint")
    meta = left.meta.unionByName(won.select("key", F.lit("STRING").alias("type"), end.alias("expire_at")))
    reply = requests.select("key").distinct().join(won.select("key", F.lit("OK").alias("reply")), "key", "left")
    return Outcome(left.with_(meta=meta, strings=left.strings.unionByName(won.select("key", "value"))), reply, None)


def write(ks: Keyspace, command: str, requests: DataFrame, *args, now_ms: int | None = None, **options) -> Outcome:
    """Apply a writing command to ``requests``, which name their keys in ``key``."""
    command = command.upper()
    kind, op = WRITES[command]
    ks = ks if now_ms is None else ks.live(now_ms)
    if command in OVERWRITES:
        return _overwritten(ks, requests, *args, **options)
    errors = ks.of_wrong_type(requests, kind)
    fine = requests.join(ks.meta.filter(F.col("type") != kind).select("key"), "key", "left_anti")
    state, reply = op(getattr(ks, RELATION[kind]), fine, *args, **options)
    return Outcome(_settled(ks, kind, state), reply, errors)


def sweep(ks: Keyspace, command: str, *args, now_ms: int | None = None, **options) -> Outcome:
    """Apply a command that takes something from every key of its type."""
    kind, op = SWEEPS[command.upper()]
    ks = ks if now_ms is None else ks.live(now_ms)
    state, reply = op(getattr(ks, RELATION[kind]), *args, **options)
    return Outcome(_settled(ks, kind, state), reply, None)


def store(ks: Keyspace, command: str, groups: DataFrame, *args, **options) -> Outcome:
    """ZUNIONSTORE, ZINTERSTORE and the sets' *STORE: ``groups`` name dest and sources; dests are taken over."""
    command = command.upper()
    makers = {"ZUNIONSTORE": ("ZSET", zsets.zunion), "ZINTERSTORE": ("ZSET", zsets.zinter), "SUNIONSTORE": ("SET", sets.sunion), "SINTERSTORE": ("SET", sets.sinter), "SDIFFSTORE": ("SET", sets.sdiff)}
    kind, op = makers[command]
    relation = RELATION[kind]
    result = op(getattr(ks, relation), groups, *args, **options).withColumnRenamed("dest", "key")
    dests = groups.select(F.col("dest").alias("key")).distinct()
    size = result.groupBy("key").agg(F.count("*").alias("size"))
    reply = dests.join(size, "key", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    gone, _ = keys.delete(ks, dests)
    return Outcome(_settled(gone, kind, getattr(gone, relation).unionByName(result)), reply, None)


# --- commands on keys of any type, on several keys, or on the bits of strings ---------------------------


def _now(now_ms: int | None) -> int:
    if now_ms is None:
        raise ValueError("this command needs the time")
    return now_ms


def _keyed(ks: Keyspace, command: str, requests: DataFrame, now_ms: int | None = None, option: str | None = None):
    """EXISTS, TTL, PTTL, DEL, EXPIRE, PERSIST, SETNX, GETEX."""
    if command == "DEL":
        after, reply = keys.delete(ks if now_ms is None else ks.live(now_ms), requests)
        return Outcome(after, reply, None)
    if command in ("EXISTS", "TTL", "PTTL"):
        return {"EXISTS": keys.exists, "TTL": keys.ttl, "PTTL": keys.pttl}[command](ks.meta, requests, _now(now_ms))
    if command == "SETNX":
        ks = ks if now_ms is None else ks.live(now_ms)
        state, reply = strings.setnx(ks.strings, ks.meta, requests)
        return Outcome(_settled(ks, "STRING", state), reply, None)
    ks = ks.live(_now(now_ms))
    if command == "GETEX":
        errors = ks.of_wrong_type(requests, "STRING")
        fine = requests.join(ks.meta.filter("type != 'STRING'").select("key"), "key", "left_anti")
        meta, reply = strings.getex(ks.strings, ks.meta, fine, now_ms)
        return Outcome(ks.with_(meta=meta, strings=ks.strings.join(meta.select("key"), "key", "left_semi")), reply, errors)
    meta, reply = keys.expire(ks.meta, requests, now_ms, option) if command == "EXPIRE" else keys.persist(ks.meta, requests, now_ms)
    return Outcome(ks.with_(meta=meta).live(now_ms), reply, None)


def _moved(ks: Keyspace, command: str, moves: DataFrame, now_ms: int | None = None) -> Outcome:
    """SMOVE, RPOPLPUSH, BRPOPLPUSH over ``moves`` (src, dest, ...); a wrong type on either side costs nothing."""
    ks = ks if now_ms is None else ks.live(now_ms)
    kind, op = ("SET", sets.smove) if command == "SMOVE" else ("LIST", lists.rpoplpush)
    other = ks.meta.filter(F.col("type") != kind).select("key")
    bad = [F.col(c).alias("key") for c in ("src", "dest")]
    wrong = moves.withColumn("key", F.explode(F.array(*bad))).join(other, "key", "left_semi")
    fine = moves.join(other.withColumnRenamed("key", "src"), "src", "left_anti").join(other.withColumnRenamed("key", "dest"), "dest", "left_anti")
    state, reply = op(getattr(ks, RELATION[kind]), fine)
    return Outcome(_settled(ks, kind, state), reply, ks.of_wrong_type(wrong, kind))


def _blocking(ks: Keyspace, command: str, waiters: DataFrame, now_ms: int | None = None) -> Outcome:
    """BLPOP, BRPOP over ``waiters`` (key, wait_seq): who finds an item takes it, the others reply null and wait on."""
    ks = ks if now_ms is None else ks.live(now_ms)
    errors = ks.of_wrong_type(waiters, "LIST")
    fine = waiters.join(ks.meta.filter("type != 'LIST'").select("key"), "key", "left_anti")
    asked = ks.lists.join(fine.select("key"), "key", "left_semi")
    reply = lists.blocking_match(asked, fine, command == "BLPOP")
    state = ks.lists.join(reply.filter("pos IS NOT NULL").select("key", "pos"), ["key", "pos"], "left_anti")
    return Outcome(_settled(ks, "LIST", state), reply, errors)


def _trimmed(ks: Keyspace, start: int, stop: int, requests: DataFrame | None = None, now_ms: int | None = None) -> Outcome:
    """LTRIM of the keys asked for, or of every list."""
    ks = ks if now_ms is None else ks.live(now_ms)
    own, rest, errors = ks.lists, None, None
    if requests is not None:
        own, rest = (ks.lists.join(requests.select("key"), "key", how) for how in ("left_semi", "left_anti"))
        errors = ks.of_wrong_type(requests, "LIST")
    state = lists.ltrim(own, start, stop)
    state = state if rest is None else state.select(rest.columns).unionByName(rest)
    return Outcome(_settled(ks, "LIST", state), own.select("key").distinct().withColumn("reply", F.lit("OK")), errors)


def _bits(ks: Keyspace, command: str, requests: DataFrame, *args, now_ms: int | None = None):
    """SETBIT, GETBIT, BITCOUNT, BITPOS and the filters' commands, on the strings of the keys asked for."""
    ks = ks if now_ms is None else ks.live(now_ms)
    errors = ks.of_wrong_type(requests, "STRING")
    fine = requests.join(ks.meta.filter("type != 'STRING'").select("key"), "key", "left_anti")
    asked = fine.select("key").distinct()
    # Opened once: what is made of a string's bits is used several times below.
    own, rest = stage(ks.strings.join(asked, "key", "left_semi"), "bits-own"), ks.strings.join(asked, "key", "left_anti")
    kind = ks.strings.schema["value"].dataType
    if command.startswith("BF."):
        filters, held, invalid = dense.filters_of(own)
        if command == "BF.EXISTS":
            return bloom.exists(filters, held, fine)
        errors = errors.select("key", "error")
        if command == "BF.RESERVE":
            taken = fine.join(own.select("key"), "key", "left_semi").select("key", F.lit("ERR item exists").alias("error"))
            made = bloom.reserve(filters.limit(0), fine.join(own.select("key"), "key", "left_anti")).state
            state = ks.strings.unionByName(stage(dense.strings_of_filters(made, held.limit(0), kind), "bits-made"))
            return Outcome(_settled(ks, "STRING", state), made.select("key", F.lit("OK").alias("reply")), errors.unionByName(taken))
        errors = errors.unionByName(fine.select("key").distinct().join(invalid, "key"))
        filters, held, reply = bloom.add(filters, held, fine.join(invalid.select("key"), "key", "left_anti"))
        state = rest.unionByName(stage(dense.strings_of_filters(filters, held, kind), "bits-made")).unionByName(own.join(invalid.select("key"), "key", "left_semi"))
        return Outcome(_settled(ks, "STRING", state), reply, errors)
    bits, sizes = dense.bits_of(own)
    if command == "GETBIT":
        return bitmaps.getbit(bits, fine)
    if command == "BITCOUNT":
        return asked.join(bitmaps.bitcount(bits, sizes, *args), "key", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    if command == "BITPOS":
        return bitmaps.bitpos(bits, asked, sizes, *args)
    bits, sizes, reply = bitmaps.setbit(bits, sizes, fine)
    return Outcome(_settled(ks, "STRING", rest.unionByName(stage(dense.strings_of(bits, sizes, kind), "bits-made"))), reply, errors)


def _bitop(ks: Keyspace, groups: DataFrame, op: str, now_ms: int | None = None) -> Outcome:
    """BITOP over ``groups`` (dest, key); a dest is taken over, and one whose result is empty goes. Replies sizes in bytes."""
    ks = ks if now_ms is None else ks.live(now_ms)
    wrong = ks.of_wrong_type(groups, "STRING").select("dest").distinct()
    fine = groups.join(wrong, "dest", "left_anti")
    bits, sizes = dense.bits_of(ks.strings.join(fine.select("key").distinct(), "key", "left_semi"))
    out, size = bitmaps.bitop(bits, sizes, fine, op.upper())
    made = stage(dense.strings_of(out.withColumnRenamed("dest", "key"), size.select(F.col("dest").alias("key"), "nbytes").filter("nbytes > 0"), ks.strings.schema["value"].dataType), "bits-made")
    dests = fine.select(F.col("dest").alias("key")).distinct()
    gone, _ = keys.delete(ks, dests)
    reply = dests.join(size.withColumnRenamed("dest", "key"), "key", "left").withColumn("nbytes", F.coalesce("nbytes", F.lit(0).cast("long")))
    return Outcome(_settled(gone, "STRING", gone.strings.unionByName(made)), reply, wrong.select(F.col("dest").alias("key")))


STORES = ("ZUNIONSTORE", "ZINTERSTORE", "SUNIONSTORE", "SINTERSTORE", "SDIFFSTORE")
_OTHERS: dict[str, Callable] = (
    dict.fromkeys(("DEL", "EXISTS", "TTL", "PTTL", "EXPIRE", "PERSIST", "SETNX", "GETEX"), _keyed) | dict.fromkeys(("SMOVE", "RPOPLPUSH", "BRPOPLPUSH"), _moved) | dict.fromkeys(("BLPOP", "BRPOP"), _blocking)
    | dict.fromkeys(("SETBIT", "GETBIT", "BITCOUNT", "BITPOS", "BF.RESERVE", "BF.ADD", "BF.EXISTS"), _bits)
)


def names() -> list[str]:
    """Every command that ``run`` takes."""
    return sorted({*READS, *WRITES, *SWEEPS, *STORES, *_OTHERS, "LTRIM", "BITOP"})


def run(ks: Keyspace, command: str, *args, **options):
    """Any command by name: the replies of one that reads, an ``Outcome`` of one that writes."""
    command = command.upper()
    if command in _OTHERS:
        return _OTHERS[command](ks, command, *args, **options)
    if command == "LTRIM":
        return _trimmed(ks, *args, **options)
    if command == "BITOP":
        return _bitop(ks, *args, **options)
    if command in STORES:
        return store(ks, command, *args, **options)
    for table, how in ((READS, read), (WRITES, write), (SWEEPS, sweep)):
        if command in table:
            return how(ks, command, *args, **options)
    raise ValueError(f"ERR unknown command '{command}'")
