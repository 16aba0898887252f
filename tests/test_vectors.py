"""Literal vectors of the commands, on the set-oriented operators and on the model."""

import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions.hashing import murmur3_32, murmur_positions
from keyloom.functions.ranges import ScoreRange, glob_to_regex
from keyloom.operators import bitmaps, bloom, hashes, keys, lists, scan, sets, strings, zsets
from keyloom.plans.model import CommandError, Store
from keyloom.schema import Keyspace


def z(spark, **sets_):
    return spark.createDataFrame([(k, m, float(s)) for k, v in sets_.items() for m, s in v.items()], "key string, member string, score double")


def ls(spark, *values, key="l"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "key string, pos bigint, value string")


def members(df, order="place"):
    return [r["member"] for r in df.orderBy(order).collect()]


def values(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_zrange(spark):
    s = z(spark, k={"a": 1, "b": 2, "c": 3})
    assert members(zsets.zrange(s, 0, 1)) == ["a", "b"]
    assert members(zsets.zrange(s, -1, -1)) == ["c"]
    assert members(zsets.zrange(s, 0, -1)) == ["a", "b", "c"]
    assert members(zsets.zrange(s, -9, 9)) == ["a", "b", "c"]
    assert members(zsets.zrange(s, 3, 5)) == []
    assert members(zsets.zrange(s, 2, 1)) == []
    assert members(zsets.zrevrange(s, 0, 1)) == ["c", "b"]
    assert members(zsets.zrevrange(s, 0, -1)) == ["c", "b", "a"]
    assert members(zsets.zrevrange(s, 0, 9)) == ["c", "b", "a"]
    assert pairs(zsets.zrange(s, -2, -1), "member", "place") == [("b", 1), ("c", 2)]


def test_ranks_and_ties(spark):
    s = z(spark, k={"B": 10, "A": 10, "C": 5})
    assert pairs(zsets.zrank(s), "member", "rank") == [("A", 1), ("B", 2), ("C", 0)]
    asked = spark.createDataFrame([("k", "B"), ("k", "none")], "key string, member string")
    assert pairs(zsets.zrank_of(s, asked).fillna(-1), "member", "rank") == [("B", 2), ("none", -1)]
    big = z(spark, k={f"user:{i}": i for i in range(2000) if i % 2})
    assert {(r["member"], r["rank"]) for r in zsets.zrank(big).filter("rank < 2").collect()} == {("user:1", 0), ("user:3", 1)}


def test_scores(spark):
    s = z(spark, k={"a": 1, "b": 2, "c": 3})
    within = ScoreRange.parse
    assert pairs(zsets.zrangebyscore(s, within("(1", "+inf")), "member") == [("b",), ("c",)]
    assert pairs(zsets.zrangebyscore(s, within("-inf", "+inf"), 1, 1), "member") == [("b",)]
    assert pairs(zsets.zrangebyscore(s, within("-inf", "+inf"), 1, -1), "member") == [("b",), ("c",)]
    assert pairs(zsets.zrangebyscore(s, within("-inf", "+inf"), 0, 0), "member") == []
    with pytest.raises(ValueError):
        zsets.zrangebyscore(s, within("1", "2"), -1)
    for bad in ("inf", "(+inf", "nan", "x", "1_0"):
        with pytest.raises(ValueError):
            within(bad, "5")
    none = spark.createDataFrame([("none",), ("k",)], "key string")
    assert pairs(zsets.zcount(s, none, within("2", "3")), "key", "count") == [("k", 2), ("none", 0)]


def test_zadd(spark):
    s = z(spark, k={"a": 1})
    w = spark.createDataFrame([("k", "a", 5.0, 1), ("k", "b", 1.0, 2), ("k", "b", 2.0, 3)], "key string, member string, score double, seq bigint")
    state, reply = zsets.zadd(s, w)
    assert pairs(reply, "key", "added") == [("k", 1)] and pairs(state, "member", "score") == [("a", 5.0), ("b", 2.0)]
    with pytest.raises(Exception, match="not a valid float"):
        zsets.zadd(s, w.withColumn("score", F.lit(math.nan))).state.collect()


def groups(spark, *rows):
    return spark.createDataFrame([("d", k, float(w)) for k, w in rows], "dest string, key string, weight double")


def test_stores(spark):
    s = z(spark, z1={"A": 1, "B": 2}, z2={"B": 3, "C": 4})
    both = groups(spark, ("z1", 1), ("z2", 1))
    assert pairs(zsets.zunion(s, both), "member", "score") == [("A", 1), ("B", 5), ("C", 4)]
    assert pairs(zsets.zinter(s, both), "member", "score") == [("B", 5)]
    assert pairs(zsets.zunion(s, groups(spark, ("z1", 2), ("z2", 3))), "member", "score") == [("A", 2), ("B", 13), ("C", 12)]
    m = z(spark, z1={"A": 10, "B": 20}, z2={"A": 15, "B": 5})
    assert pairs(zsets.zunion(m, both, "MAX"), "member", "score") == [("A", 15), ("B", 20)]
    gone = groups(spark, ("missing", 1), ("z2", 1))
    state, reply = zsets.store(s, zsets.zinter(s, gone), gone)
    assert pairs(reply, "key", "size") == [("d", 0)] and state.filter("key = 'd'").isEmpty()
    assert pairs(zsets.store(s, zsets.zunion(s, gone), gone).reply, "size") == [(2,)]


def test_zset_removals(spark):
    s = z(spark, k={c: i for i, c in enumerate("abcdef")})
    assert pairs(zsets.zremrangebyrank(s, 1, -2).state, "member") == [("a",), ("f",)]
    assert pairs(zsets.zremrangebyscore(s, ScoreRange.parse("(0", "4")).state, "member") == [("a",), ("f",)]


def test_hashes(spark):
    h = spark.createDataFrame([("h", "f", "v")], "key string, field string, value string")
    w = spark.createDataFrame([("h", "f", "w", 1), ("h", "g", "x", 2)], "key string, field string, value string, seq bigint")
    state, reply = hashes.hset(h, w)
    assert pairs(reply, "added") == [(1,)] and pairs(state, "field", "value") == [("f", "w"), ("g", "x")]
    gone = hashes.hdel(h, w.select("key", "field"))
    assert gone.state.isEmpty() and pairs(gone.reply, "removed") == [(1,)]
    n = spark.createDataFrame([("h", "n", 10), ("h", "n", 5), ("h", "n", -20)], "key string, field string, delta bigint")
    assert pairs(hashes.hincrby(h, n).reply, "field", "value") == [("n", -5)]
    bad = hashes.hincrby(h, n.withColumn("field", F.lit("f")))
    assert bad.reply.first()["error"] and pairs(bad.state, "value") == [("v",)]


def test_wrong_type(spark):
    ks = Keyspace.empty(spark).with_(meta=spark.createDataFrame([("s", "STRING", None)], "key string, type string, expire_at bigint"))
    assert ks.of_wrong_type(spark.createDataFrame([("s",), ("h",)], "key string"), "HASH").first()["error"].startswith("WRONGTYPE")


def test_counters(spark):
    s = spark.createDataFrame([("n", "7"), ("t", "text"), ("m", str((1 << 63) - 1))], "key string, value string")
    d = spark.createDataFrame([("n", 5), ("n", -2), ("t", 1), ("m", 1), ("new", 3)], "key string, delta bigint")
    got = {r["key"]: (r["value"], r["error"] is None) for r in strings.incr_by(s, d).reply.collect()}
    assert got == {"n": (10, True), "t": (None, False), "m": (None, False), "new": (3, True)}
    assert pairs(strings.strlen(spark.createDataFrame([("k", "ñ")], "key string, value string"), spark.createDataFrame([("k",), ("x",)], "key string")), "key", "length") == [("k", 2), ("x", 0)]
    w = spark.createDataFrame([("k", "b", 2), ("k", "a", 1)], "key string, value string, seq bigint")
    assert pairs(strings.append(s.limit(0), w).state, "value") == [("ab",)]


def test_lists(spark):
    q = ls(spark, *"abcab")
    assert values(lists.lrem(q, spark.createDataFrame([("l", "a")], "key string, value string"), 1).state) == list("bcab")
    assert values(lists.lrem(q, spark.createDataFrame([("l", "b")], "key string, value string"), -1).state) == list("abca")
    w = spark.createDataFrame([("l", "x", 1), ("l", "y", 2)], "key string, value string, seq bigint")
    assert values(lists.push(q, w, left=True).state) == list("yxabcab")
    assert values(lists.push(q, w).state) == list("abcabxy")
    assert lists.push(q.limit(0), w, only_existing=True).reply.first()["length"] == 0
    ins = spark.createDataFrame([("l", "b", "N"), ("none", "b", "N")], "key string, pivot string, value string")
    assert values(lists.linsert(q, ins).state) == list("aNbcab") and values(lists.linsert(q, ins, before=False).state) == list("abNcab")
    assert pairs(lists.linsert(q, ins).reply, "key", "length") == [("l", 6), ("none", 0)]
    assert pairs(lists.linsert(q, ins.withColumn("pivot", F.lit("?"))).reply, "length") == [(-1,), (0,)]
    sets_ = spark.createDataFrame([("l", "N"), ("none", "N")], "key string, value string")
    assert {r["key"]: r["error"] for r in lists.lset(q, sets_, 9).reply.collect()} == {"l": "ERR index out of range", "none": "ERR no such key"}
    assert values(lists.lset(q, sets_, -1).state) == list("abcaN")
    assert values(lists.ltrim(q, 5, 9)) == [] and values(lists.ltrim(q, 1, -2)) == list("bca")
    got = lists.rpoplpush(q, spark.createDataFrame([("l", "d", 1), ("l", "d", 2)], "src string, dest string, seq bigint"))
    assert values(got.state.filter("key = 'd'")) == ["a", "b"] and values(got.state.filter("key = 'l'")) == list("abc")


def test_bits(spark):
    b = spark.createDataFrame([("ones", i) for i in range(16)] + [("k", 1), ("k", 9)], "key string, bit bigint")
    n = bitmaps.sizes_of(b)
    ask = spark.createDataFrame([("ones",), ("k",), ("none",)], "key string")
    assert pairs(bitmaps.bitpos(b, ask, n, 0), "key", "bitpos") == [("k", 0), ("none", 0), ("ones", 16)]
    assert pairs(bitmaps.bitpos(b, ask, n, 1), "key", "bitpos") == [("k", 1), ("none", -1), ("ones", 0)]
    assert pairs(bitmaps.bitcount(b, n, -1, -1), "key", "count") == [("k", 1), ("ones", 8)]
    assert pairs(bitmaps.bitcount(b, n, 5, 9), "key", "count") == [("k", 0), ("ones", 0)]
    g = spark.createDataFrame([("d", "ones"), ("d", "none")], "dest string, key string")
    assert bitmaps.bitop(b, n, g, "AND")[0].isEmpty() and bitmaps.bitop(b, n, g, "XOR")[0].count() == 16
    dense = bitmaps.to_bytes(b, n)
    assert {r["key"]: bytes(r["value"]) for r in dense.collect()} == {"ones": b"\xff\xff", "k": b"\x40\x40"}
    back, size = bitmaps.from_bytes(dense)
    assert pairs(back, "key", "bit") == pairs(b, "key", "bit") and pairs(size, "key", "nbytes") == pairs(n, "key", "nbytes")
    w = spark.createDataFrame([("k", 1, 0, 1), ("new", 100, 0, 2)], "key string, bit bigint, v int, seq bigint")
    bits, size, old = bitmaps.setbit(b, n, w)
    assert pairs(bits.filter("key = 'k'"), "bit") == [(9,)] and pairs(old, "key", "old") == [("k", 1), ("new", 0)]
    assert ("new", 13) in pairs(size, "key", "nbytes")


def test_sets(spark):
    s = spark.createDataFrame([("a", m) for m in "xyz"] + [("b", m) for m in "yz"], "key string, member string")
    g = spark.createDataFrame([("d", "a", 0), ("d", "b", 1)], "dest string, key string, ord int")
    assert pairs(sets.sdiff(s, g), "member") == [("x",)] and pairs(sets.sinter(s, g), "member") == [("y",), ("z",)]
    gone = spark.createDataFrame([("d", "a", 0), ("d", "none", 1)], "dest string, key string, ord int")
    assert sets.sinter(s, gone).isEmpty() and pairs(sets.sintercard(s, gone), "card") == [(0,)]
    assert [sets.sintercard(s, g, n).first()["card"] for n in (0, 1, 9)] == [2, 1, 2]
    mv = spark.createDataFrame([("a", "b", "x"), ("a", "b", "?")], "src string, dest string, member string")
    state, reply = sets.smove(s, mv)
    assert pairs(state, "key", "member") == [("a", "y"), ("a", "z"), ("b", "x"), ("b", "y"), ("b", "z")] and pairs(reply, "reply") == [(0,), (1,)]
    left, out = sets.spop(s, 2, seed=4)
    assert out.count() == 4 and left.count() == 1 and sets.srandmember(s, -7).count() == 14
    with pytest.raises(ValueError):
        sets.spop(s, -1)


def test_keys(spark):
    meta = spark.createDataFrame([("at", "STRING", 100), ("past", "STRING", 99), ("none", "STRING", None)], "key string, type string, expire_at bigint")
    ask = spark.createDataFrame([("at",), ("past",), ("none",), ("absent",)], "key string")
    assert pairs(keys.pttl(meta, ask, 100), "key", "pttl") == [("absent", -2), ("at", 0), ("none", -1), ("past", -2)]
    assert keys.exists(meta, ask.unionByName(ask), 100).first()[0] == 4
    asked = spark.createDataFrame([(k, 1) for k in ("at", "past", "none", "absent")], "key string, seconds bigint")
    for option, want in ((None, (0, 1, 1, 0)), ("NX", (0, 0, 1, 0)), ("XX", (0, 1, 0, 0)), ("GT", (0, 1, 0, 0)), ("LT", (0, 0, 1, 0))):
        assert [r for _, r in pairs(keys.expire(meta, asked, 100, option).reply, "key", "reply")] == list(want), option
    with pytest.raises(ValueError):
        keys.expire(meta, asked, 100, "ZZ")


def test_bloom(spark):
    assert [murmur3_32(x) for x in (b"", b"hello", b"hello, world", b"aaaa")] == [0, 0x248BFA47, 0x149BBB7F, 0x7EEED987]
    assert all(0 <= p < 8192 for p in murmur_positions("ñ-long item".encode(), 8192, 5))
    none = spark.createDataFrame([], "key string, m bigint, k bigint"), spark.createDataFrame([], "key string, pos bigint")
    items = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("b", "x", 3)], "key string, item string, seq bigint")
    for how in ("murmur", "md5"):
        f, bits, reply = bloom.add(*none, items, how)
        assert pairs(reply, "seq", "added") == [(1, 1), (2, 1), (3, 0)]
        ask = spark.createDataFrame([("b", "x"), ("b", "absent"), ("other", "x")], "key string, item string")
        assert pairs(bloom.exists(f, bits, ask, how), "key", "item", "reply") == [("b", "absent", 0), ("b", "x", 1), ("other", "x", 0)]


def test_scan(spark):
    s = spark.createDataFrame([("k", m) for m in ("a", "b", "ab", "a|b", "a.b")], "key string, member string")
    assert pairs(scan.sscan(s, 0, 3, "a*"), "member", "next_cursor") == [("a", 3), ("a.b", 3), ("ab", 3)] or scan.sscan(s, 0, 3).count() == 3
    assert pairs(scan.sscan(s, 0, 10, "a|b"), "member", "next_cursor") == [("a|b", 0)]
    assert pairs(scan.sscan(s, 0, 10, "a.?"), "member") == [("a.b",)]
    assert scan.sscan(s, 99).isEmpty()
    assert glob_to_regex("a?(b)*") == "^(?s:a.\\(b\\).*)\\z"


def test_model_vectors():
    m = Store()
    run = m.execute
    assert run("ZADD", "z", "10", "A", "30", "C", "20", "B") == 3 and [x for x, _ in run("ZRANGE", "z", "0", "-1")] == ["A", "B", "C"]
    assert run("HSET", "h", "f", "1") == 1 and run("HSET", "h", "f", "2") == 0 and run("HDEL", "h", "f") == 1 and run("EXISTS", "h") == 0
    assert run("HINCRBY", "n", "f", "10") == 10 and run("HINCRBY", "n", "f", "-20") == -10
    run("SET", "s", "v")
    with pytest.raises(CommandError, match="WRONGTYPE"):
        run("HSET", "s", "f", "v")
    run("RPUSH", "list1", "val1")
    assert run("RPOP", "list1") == "val1" and run("EXISTS", "list1") == 0
    assert run("SET", "s", "w", "NX") is None and run("SET", "t", "x", "EX", "1", now_ms=0) == "OK" and run("GET", "t", now_ms=1000) == "x" and run("GET", "t", now_ms=1001) is None
    assert run("ZUNIONSTORE", "u", "2", "z", "none", "WEIGHTS", "2", "3") == 3 and run("ZSCORE", "u", "A") == 20
    assert run("SETBIT", "b", "7", "1") == 0 and run("BITCOUNT", "b") == 1 and run("BITPOS", "b", "1") == 7


def test_components_with_hubs(spark, monkeypatch):
    from keyloom.operators import components
    from keyloom.sources.staging import stage

    rows = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(70)] + [(59, 500), (500, 501), (7, 7)]
    edges = spark.createDataFrame(rows, "u long, v long")
    want = {**{i: 0 for i in [*range(60), 500, 501]}, **{100 + i: 100 for i in range(71)}}
    for hub in (components.HUB, 5):
        monkeypatch.setattr(components, "HUB", hub)
        assert {r["node"]: r["component"] for r in components.connected_components(edges, stage).collect()} == want


def test_ranks_by_ranges(spark):
    """Places from either end of keys with many equal scores, against sorted lists."""
    from keyloom.operators import lists, zsets

    rows = [("hot", f"m{i:04d}", float(i * 7919 % 40)) for i in range(900)] + [("one", "x", 1.0)] + [("flat", f"f{i}", 2.0) for i in range(70)]
    z = spark.createDataFrame(rows, "key string, member string, score double")
    up = {k: sorted((s, m) for key, m, s in rows if key == k) for k in ("hot", "one", "flat")}
    for start, stop in ((3, -4), (-5, 2), (0, -1), (-800, 200)):
        for op, order in ((zsets.zrange, up), (zsets.zrevrange, {k: v[::-1] for k, v in up.items()})):
            want = set()
            for k, v in order.items():
                n = len(v)
                first, last = max(start if start >= 0 else n + start, 0), min(stop if stop >= 0 else n + stop, n - 1)
                want |= {(k, v[i][1], i) for i in range(first, last + 1)}
            assert {(r["key"], r["member"], r["place"]) for r in op(z, start, stop).collect()} == want
    assert {(r["key"], r["member"]): r["rank"] for r in zsets.zrank(z, reverse=True).collect()} == {(k, m): len(v) - 1 - i for k, v in up.items() for i, (_, m) in enumerate(v)}
    q = spark.createDataFrame([("l", i * 3, f"v{i}") for i in range(300)] + [("s", 5, "a")], "key string, pos long, value string")
    assert [r["value"] for r in lists.lrange(q, 2, -3).orderBy("pos").collect()] == [f"v{i}" for i in range(2, 298)]
