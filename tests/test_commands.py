"""Commands by name over a keyspace: type checks, metadata, overwriting."""

import datetime

from keyloom.plans import commands
from keyloom.plans.replay import replay

LOG = "seq bigint, ts timestamp_ntz, cmd string, key string, args array<string>"


def keyspace(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("SET", "s", ["5"]), ("HSET", "h", ["f", "v"]), ("RPUSH", "l", ["a", "b"]), ("SADD", "m", ["x", "y"]), ("ZADD", "z1", ["1", "A", "2", "B"]), ("ZADD", "z2", ["3", "B", "4", "C"])]
    return replay(spark.createDataFrame([(i, t, c, k, a) for i, (c, k, a) in enumerate(rows)], LOG))


def types(ks):
    return {r["key"]: r["type"] for r in ks.meta.collect()}


def test_reads(spark):
    ks = keyspace(spark)
    assert types(ks) == {"s": "STRING", "h": "HASH", "l": "LIST", "m": "SET", "z1": "ZSET", "z2": "ZSET"}
    assert [r["member"] for r in commands.read(ks, "zrange", 0, 0).orderBy("key").collect()] == ["A", "B"]
    assert commands.read(ks, "GET", spark.createDataFrame([("s",), ("none",)], "key string")).count() == 2


def test_writes_and_wrong_types(spark):
    ks = keyspace(spark)
    out = commands.write(ks, "HSET", spark.createDataFrame([("h", "g", "w", 1), ("s", "g", "w", 2), ("new", "g", "w", 3)], "key string, field string, value string, seq bigint"))
    assert {r["key"]: r["added"] for r in out.reply.collect()} == {"h": 1, "new": 1}
    assert [r["key"] for r in out.errors.collect()] == ["s"] and types(out.keyspace)["new"] == "HASH" and types(out.keyspace)["s"] == "STRING"
    gone = commands.write(ks, "SREM", spark.createDataFrame([("m", "x"), ("m", "y")], "key string, member string"))
    assert "m" not in types(gone.keyspace)
    taken = commands.write(ks, "SET", spark.createDataFrame([("h", "v", 1)], "key string, value string, seq bigint"))
    assert types(taken.keyspace)["h"] == "STRING" and taken.keyspace.hashes.isEmpty()


def test_sweeps_and_stores(spark):
    ks = keyspace(spark)
    out = commands.sweep(ks, "LPOP", 2)
    assert [r["value"] for r in out.reply.orderBy("place").collect()] == ["a", "b"] and "l" not in types(out.keyspace)
    groups = spark.createDataFrame([("l", "z1", 2.0), ("l", "z2", 3.0)], "dest string, key string, weight double")
    got = commands.store(ks, "ZUNIONSTORE", groups)
    assert got.reply.first()["size"] == 3 and types(got.keyspace)["l"] == "ZSET" and got.keyspace.lists.isEmpty()
    assert {r["member"]: r["score"] for r in got.keyspace.zsets.filter("key = 'l'").collect()} == {"A": 2, "B": 13, "C": 12}
    none = spark.createDataFrame([("s", "z1", 1.0), ("s", "absent", 1.0)], "dest string, key string, weight double")
    assert "s" not in types(commands.store(ks, "ZINTERSTORE", none).keyspace)


#: Every command on data that the engine is to take.
DATA_COMMANDS = (
    "DEL EXPIRE EXISTS TTL PTTL SET GETEX GET INCR MSET MGET SETNX DECRBY DECR INCRBY GETBIT SETBIT BITCOUNT APPEND STRLEN BITOP BITPOS HSET HGET HDEL HGETALL HLEN HEXISTS HINCRBY HKEYS HVALS HMGET "
    "LPOP LPUSH LPUSHX LINDEX LINSERT LLEN LREM LSET LTRIM LRANGE RPOP RPUSH RPUSHX BLPOP BRPOP BRPOPLPUSH SADD SCARD SISMEMBER SMEMBERS SPOP SRANDMEMBER SREM SUNION SINTER SDIFF SMOVE SSCAN SINTERCARD "
    "ZADD ZRANGE ZSCORE ZCOUNT ZRANGEBYSCORE ZREVRANGE ZSCAN ZINCRBY ZREMRANGEBYRANK ZREMRANGEBYSCORE ZUNIONSTORE ZINTERSTORE BF.RESERVE BF.ADD BF.EXISTS"
).split()


def test_every_command_is_taken():
    assert set(DATA_COMMANDS) <= set(commands.names())


def values(ks):
    return {r["key"]: r["value"] for r in ks.strings.collect()}


def test_bits_and_filters_are_strings(spark):
    ks = keyspace(spark)
    writes = spark.createDataFrame([("b", 1, 1, 1), ("b", 17, 1, 2), ("b", 17, 0, 3), ("s", 7, 0, 4), ("h", 1, 1, 5)], "key string, bit long, v int, seq long")
    out = commands.run(ks, "SETBIT", writes)
    assert values(out.keyspace) == {"b": "@\0\0", "s": "4"} and [r["key"] for r in out.errors.collect()] == ["h"] and types(out.keyspace)["b"] == "STRING"
    assert {(r["key"], r["bit"], r["old"]) for r in out.reply.collect()} == {("b", 1, 0), ("b", 17, 0), ("s", 7, 1)}
    one = spark.createDataFrame([("b",), ("none",)], "key string")
    assert {r["key"]: r["count"] for r in commands.run(out.keyspace, "BITCOUNT", one).collect()} == {"b": 1, "none": 0}
    assert {r["key"]: r["bitpos"] for r in commands.run(out.keyspace, "BITPOS", one, 1).collect()} == {"b": 1, "none": -1}
    assert commands.run(out.keyspace, "GETBIT", spark.createDataFrame([("b", 1), ("b", 900)], "key string, bit long")).agg({"v": "sum"}).first()[0] == 1
    groups = spark.createDataFrame([("h", "b"), ("h", "s"), ("x", "none"), ("y", "l")], "dest string, key string")
    got = commands.run(out.keyspace, "BITOP", groups, "OR")
    assert values(got.keyspace)["h"] == "t\0\0" and got.keyspace.hashes.isEmpty() and {r["key"]: r["nbytes"] for r in got.reply.collect()} == {"h": 3, "x": 0}
    assert "x" not in types(got.keyspace) and [r["key"] for r in got.errors.collect()] == ["y"]
    made = commands.run(ks, "BF.RESERVE", spark.createDataFrame([("f", 64, 3), ("s", 64, 3)], "key string, m long, k long"))
    assert len(values(made.keyspace)["f"]) == 16 and [r["key"] for r in made.errors.collect()] == ["s"]
    items = spark.createDataFrame([("f", "a", 1), ("f", "a", 2), ("g", "b", 3), ("s", "c", 4)], "key string, item string, seq long")
    added = commands.run(made.keyspace, "BF.ADD", items)
    assert {(r["seq"], r["added"]) for r in added.reply.collect()} == {(1, 1), (2, 0), (3, 1)} and [r["key"] for r in added.errors.collect()] == ["s"]
    asked = spark.createDataFrame([("f", "a"), ("f", "zz"), ("g", "b"), ("none", "a")], "key string, item string")
    assert {(r["key"], r["item"]): r["reply"] for r in commands.run(added.keyspace, "BF.EXISTS", asked).collect()} == {("f", "a"): 1, ("f", "zz"): 0, ("g", "b"): 1, ("none", "a"): 0}
    from keyloom.plans.model import Store

    m = Store()  # the same filter, command by command
    m.execute("BF.RESERVE", "f", "64", "3")
    m.execute("BF.ADD", "f", "a")
    m.execute("BF.ADD", "g", "b")
    got = values(added.keyspace)
    assert got["f"] == m.execute("GET", "f") and got["g"] == m.execute("GET", "g") and got["s"] == "5"


def test_keys_and_moves(spark):
    now = 10_000
    ks = keyspace(spark)
    asked = spark.createDataFrame([("s", 5), ("l", 0), ("none", 5)], "key string, seconds long")
    out = commands.run(ks, "EXPIRE", asked, now_ms=now)
    assert {r["key"]: r["reply"] for r in out.reply.collect()} == {"s": 1, "l": 1, "none": 0}
    one = spark.createDataFrame([("s",), ("l",), ("h",), ("none",)], "key string")
    assert {r["key"]: r["ttl"] for r in commands.run(out.keyspace, "TTL", one, now_ms=now + 1).collect()} == {"s": 4, "l": -2, "h": -1, "none": -2}
    assert commands.run(out.keyspace, "EXISTS", one, now_ms=now + 1).first()["found"] == 2
    kept = commands.run(out.keyspace, "PERSIST", one, now_ms=now + 1)
    assert {r["key"]: r["expire_at"] for r in kept.keyspace.meta.collect()}["s"] is None and "l" not in types(kept.keyspace) and kept.keyspace.lists.isEmpty()
    gone = commands.run(kept.keyspace, "DEL", spark.createDataFrame([("s",), ("s",), ("none",)], "key string"))
    assert gone.reply.first()["removed"] == 1 and gone.keyspace.strings.isEmpty()
    new = commands.run(ks, "SETNX", spark.createDataFrame([("h", "v", 1), ("n", "v", 2)], "key string, value string, seq long"))
    assert values(new.keyspace) == {"s": "5", "n": "v"} and types(new.keyspace)["n"] == "STRING"
    ends = spark.createDataFrame([("s", now - 1, False), ("h", now + 5, False)], "key string, expire_at long, persist boolean")
    read = commands.run(ks, "GETEX", ends, now_ms=now)
    assert "s" not in types(read.keyspace) and read.keyspace.strings.isEmpty() and [r["key"] for r in read.errors.collect()] == ["h"]
    assert values(commands.run(ks, "DECRBY", spark.createDataFrame([("s", 7)], "key string, delta long")).keyspace)["s"] == "-2"
    assert values(commands.run(ks, "INCR", spark.createDataFrame([("s",), ("s",), ("c",)], "key string")).keyspace) == {"s": "7", "c": "1"}
    moved = commands.run(ks, "SMOVE", spark.createDataFrame([("m", "m2", "x"), ("m", "h", "y"), ("m", "m2", "q")], "src string, dest string, member string"))
    assert {(r["key"], r["member"]) for r in moved.keyspace.sets.collect()} == {("m", "y"), ("m2", "x")} and {(r["member"], r["reply"]) for r in moved.reply.collect()} == {("x", 1), ("q", 0)} and types(moved.keyspace)["m2"] == "SET"
    pushed = commands.run(ks, "BRPOPLPUSH", spark.createDataFrame([("l", "d", 1), ("l", "d", 2), ("l", "d", 3)], "src string, dest string, seq long"))
    assert [r["value"] for r in pushed.keyspace.lists.filter("key = 'd'").orderBy("pos").collect()] == ["a", "b"] and "l" not in types(pushed.keyspace) and types(pushed.keyspace)["d"] == "LIST"
    popped = commands.run(ks, "BRPOP", spark.createDataFrame([("l", 1), ("l", 2), ("l", 3), ("s", 4)], "key string, wait_seq long"))
    assert {r["wait_seq"]: r["value"] for r in popped.reply.collect()} == {1: "b", 2: "a", 3: None} and popped.keyspace.lists.isEmpty() and [r["key"] for r in popped.errors.collect()] == ["s"]
    cut = commands.run(ks, "LTRIM", 1, -1, spark.createDataFrame([("l",)], "key string"))
    assert [r["value"] for r in cut.keyspace.lists.collect()] == ["b"]


def test_set_with_conditions_and_ends(spark):
    now = 1_000
    ks = commands.run(keyspace(spark), "EXPIRE", spark.createDataFrame([("s", 50), ("h", 50)], "key string, seconds long"), now_ms=now).keyspace
    ends = lambda k: {r["key"]: r["expire_at"] for r in k.meta.collect()}
    writes = spark.createDataFrame([("s", "1", 1, 9_000), ("s", "2", 2, None), ("h", "3", 3, 7_000), ("n", "4", 4, 5_000), ("n", "5", 5, None)], "key string, value string, seq long, expire_at long")
    plain = commands.run(ks, "SET", writes).keyspace
    assert values(plain) == {"s": "2", "h": "3", "n": "5"} and plain.hashes.isEmpty() and {k: ends(plain)[k] for k in "shn"} == {"s": None, "h": 7_000, "n": None}
    fresh = commands.run(ks, "SET", writes, "NX")
    assert values(fresh.keyspace) == {"s": "5", "n": "4"} and types(fresh.keyspace)["h"] == "HASH" and {k: ends(fresh.keyspace)[k] for k in "shn"} == {"s": 51_000, "h": 51_000, "n": 5_000}
    assert {r["key"]: r["reply"] for r in fresh.reply.collect()} == {"s": None, "h": None, "n": "OK"}
    held = commands.run(ks, "SET", writes.drop("expire_at"), "XX").keyspace
    assert values(held) == {"s": "2", "h": "3"} and "n" not in types(held) and ends(held)["h"] is None
