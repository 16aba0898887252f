"""Log replay against the model of single commands, snapshots, wire logs and streams."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions.scores import score_text
from keyloom.plans.model import CommandError, Store
from keyloom.plans.replay import as_commands, replay, replay_onto, unknown_commands
from keyloom.sources.storage import (
    SimpleString,
    Snapshots,
    WireError,
    append_log,
    decode_commands,
    decode_values,
    encode_command,
    encode_value,
    read_log,
    rewrite_is_due,
    rewrite_log,
    save_is_due,
    write_wire_log,
)

LOG = "seq bigint, ts timestamp_ntz, cmd string, key string, args array<string>"


def random_log(n, seed, single=False):
    import datetime

    rng, rows = random.Random(seed), []
    key = lambda kind: f"{kind}{rng.randrange(4)}"
    small = lambda: str(rng.randrange(-3, 9))
    word = lambda: rng.choice("abcdef")
    makers = [
        lambda: ("SET", key("s"), [small()]), lambda: ("INCRBY", key("s"), [small()]), lambda: ("INCR", key("s"), []), lambda: ("DEL", key(rng.choice("shlzm")), []),
        lambda: ("HSET", key("h"), [word(), small()]), lambda: ("HDEL", key("h"), [word()]), lambda: ("HSET", key("g"), [word(), word(), word(), word()]), lambda: ("HINCRBY", key("n"), [word(), small()]), lambda: ("HDEL", key("n"), [word()]),
        lambda: ("SADD", key("m"), [word(), word()]), lambda: ("SREM", key("m"), [word()]),
        lambda: ("ZADD", key("z"), [small(), word(), small(), word()]), lambda: ("ZINCRBY", key("z"), [small(), word()]), lambda: ("ZREM", key("z"), [word()]),
        lambda: ("RPUSH", key("p"), [word(), word()]), lambda: ("LPUSH", key("p"), [word(), word()]),
    ]
    if not single:
        makers += [
            lambda: ("LPUSH", key("l"), [word()]), lambda: ("RPUSH", key("l"), [word(), word()]), lambda: ("LPOP", key("l"), []), lambda: ("LREM", key("l"), [small(), word()]), lambda: ("LTRIM", key("l"), ["0", small()]),
            lambda: ("LINSERT", key("l"), ["BEFORE", word(), word()]), lambda: ("RPOPLPUSH", key("l"), [key("l")]), lambda: ("SMOVE", key("v"), [key("v"), word()]), lambda: ("SADD", key("v"), [word()]),
            lambda: ("ZUNIONSTORE", key("y"), ["2", key("y"), key("y")]), lambda: ("ZADD", key("y"), [small(), word()]), lambda: ("SET", key("x"), [word()]), lambda: ("INCR", key("x"), []), lambda: ("HSET", key("x"), [word(), word()]),
            lambda: ("EXPIRE", key("x"), ["5"]), lambda: ("APPEND", key("x"), [word()]),
        ]
    start = datetime.datetime(2024, 1, 1)
    for seq in range(n):
        cmd, k, args = rng.choice(makers)()
        rows.append((seq, start + datetime.timedelta(seconds=seq), cmd, k, args))
    return rows


def by_model(rows):
    m = Store()
    for _, ts, cmd, key, args in rows:
        ms = (ts - ts.__class__(1970, 1, 1)).total_seconds() * 1000
        try:
            m.execute(cmd, key, *args, now_ms=int(ms))
        except CommandError:
            pass
    return m


def contents(ks):
    out = {}
    for r in ks.strings.collect():
        out[r["key"]] = ("STRING", r["value"])
    for rel, kind, make in ((ks.hashes, "HASH", lambda r: (r["field"], r["value"])), (ks.sets, "SET", lambda r: r["member"]), (ks.zsets, "ZSET", lambda r: (r["member"], r["score"]))):
        for r in rel.collect():
            out.setdefault(r["key"], (kind, set()))[1].add(make(r))
    for r in ks.lists.orderBy("key", "pos").collect():
        out.setdefault(r["key"], ("LIST", []))[1].append(r["value"])
    return out


def last_ms(rows):
    """When the log ends: what is past its time by then is gone."""
    return int((rows[-1][1] - rows[-1][1].__class__(1970, 1, 1)).total_seconds() * 1000)


def expected(m):
    make = {"STRING": lambda d: d, "HASH": lambda d: set(d.items()), "SET": set, "ZSET": lambda d: set(d.items()), "LIST": list}
    return {k: (t, make[t](d)) for k, (t, d) in m.data.items()}


def test_replay_equals_model(spark):
    for seed, single in ((1, True), (2, False)):
        rows = random_log(600, seed, single)
        model = by_model(rows)
        ks = replay(spark.createDataFrame(rows, LOG))
        ks = ks.live(last_ms(rows))
        assert contents(ks) == expected(model)
        assert {r["key"]: r["expire_at"] for r in ks.meta.collect() if r["expire_at"]} == model.ends


def test_empty_and_bad_commands(spark):
    assert replay(spark.createDataFrame([], LOG)).meta.isEmpty()
    import datetime

    t = datetime.datetime(2024, 1, 1)
    bad = [(1, t, "NOPE", "a", []), (2, t, "SET", "a", None), (3, t, "ZADD", "z", ["x", "m"]), (4, t, "SET", "b", ["1"])]
    assert contents(replay(spark.createDataFrame(bad, LOG))) == {"b": ("STRING", "1")}


def test_snapshot_and_tail(spark, tmp_path):
    rows = random_log(300, 5)
    log, shots = spark.createDataFrame(rows, LOG), Snapshots(spark, str(tmp_path / "snap"))
    append_log(log.filter("seq < 150"), str(tmp_path / "log"))
    assert shots.load() is None
    shots.save(replay(read_log(spark, str(tmp_path / "log"))), seq=149)
    append_log(log.filter("seq >= 150"), str(tmp_path / "log"))
    tail = read_log(spark, str(tmp_path / "log"), after=shots.manifest()["seq"])
    ks = replay(tail, shots.load())
    assert contents(ks.live(last_ms(rows))) == expected(by_model(rows))
    again = replay(tail.limit(0), ks)
    assert contents(again) == contents(ks)
    assert as_commands(ks).filter("cmd NOT IN ('SET', 'HSET', 'SADD', 'ZADD', 'RPUSH', 'PEXPIREAT')").isEmpty()
    shots.save(ks, seq=299)
    shots.vacuum()
    assert {k: shots.manifest()[k] for k in ("version", "seq")} == {"version": 2, "seq": 299} and not (tmp_path / "snap" / "v1").exists()


def test_a_crash_leaves_the_manifest_before(spark, tmp_path, monkeypatch):
    shots = Snapshots(spark, str(tmp_path / "snap"))
    ks = replay(spark.createDataFrame(random_log(30, 1), LOG))
    shots.save(ks, seq=29)
    point = Snapshots._point

    def crash(self, version, about):  # after the new manifest's text, before its name
        (tmp_path / "snap" / f".manifest-{version:012d}.new").write_text('{"version": 2, "se')
        raise OSError

    monkeypatch.setattr(Snapshots, "_point", crash)
    try:
        shots.save(ks, seq=40)
    except OSError:
        pass
    monkeypatch.setattr(Snapshots, "_point", point)
    assert (shots.manifest()["version"], shots.manifest()["seq"]) == (1, 29) and contents(shots.load()) == contents(ks)
    assert shots.save(ks, seq=41) == 2 and (shots.manifest()["version"], shots.manifest()["seq"]) == (2, 41)
    other = Snapshots(spark, str(tmp_path / "snap"))
    monkeypatch.setattr(Snapshots, "manifest", lambda self: {"version": 1, "seq": 29})  # a writer that has not seen version 2
    with pytest.raises(RuntimeError):
        other.save(ks, seq=50)


def test_layers_over_a_snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Snapshots, "LAYERS", 3)
    rows, shots = random_log(250, 11), Snapshots(spark, str(tmp_path / "snap"))
    log = spark.createDataFrame(rows, LOG)
    shots.save(replay(log.filter("seq < 150")), seq=149)
    for k, low in enumerate(range(150, 250, 25)):
        shots.append(*replay_onto(log.filter(f"seq >= {low} AND seq < {low + 25}"), shots.load()), seq=low + 24)
        assert shots.manifest()["seq"] == low + 24 and len(shots.manifest()["layers"]) == (2, 3, 1, 2)[k]
        now = rows[low + 24 : low + 25]
        assert contents(shots.load(last_ms(now))) == expected(by_model(rows[: low + 25]))
    layers = shots.manifest()["layers"]
    assert spark.read.parquet(str(tmp_path / "snap" / f"v{layers[-1]}" / "touched")).count() <= 25 * 2
    shots.vacuum()
    assert contents(shots.load(last_ms(rows))) == expected(by_model(rows))


def test_rules_of_saving_and_rewriting():
    assert save_is_due(1, 901) and not save_is_due(1, 900) and not save_is_due(0, 10**6) and save_is_due(10, 301) and save_is_due(10_000, 61) and not save_is_due(9_999, 61)
    assert rewrite_is_due(65 << 20, 0, 60) and not rewrite_is_due(65 << 20, 0, 59) and not rewrite_is_due(63 << 20, 1, 99) and not rewrite_is_due(65 << 20, 66 << 20, 99) and rewrite_is_due(66 << 20, 66 << 20, 99)


def at(*rows):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    return [(i, start + datetime.timedelta(seconds=t), c, k, a) for i, (t, c, k, a) in enumerate(rows)]


def test_chain_of_a_thousand_keys(spark):
    rows = at((0, "SADD", "k0000", ["m"]), *((i, "SMOVE", f"k{i:04d}", [f"k{i + 1:04d}", "m"]) for i in range(1000)))
    assert contents(replay(spark.createDataFrame(rows, LOG))) == {"k1000": ("SET", {"m"})}


def test_commands_of_several_keys(spark):
    rows = at(
        (0, "SETBIT", "a", ["1", "1"]), (1, "SETBIT", "b", ["7", "1"]), (2, "BITOP", "OR", ["c", "a", "b"]), (3, "BF.ADD", "f", ["x"]), (4, "BF.RESERVE", "g", ["64", "2"]), (5, "BF.ADD", "g", ["ñ"]), (6, "RPUSH", "l", ["1", "2"]),
        (7, "BRPOPLPUSH", "l", ["r", "0"]), (8, "BLPOP", "none", ["l", "0"]), (9, "SADD", "s", ["p", "q"]), (10, "SPOP", "s", []), (11, "MSET", "m1", ["v", "m2", "w"]), (12, "ZADD", "z", ["1", "x"]), (13, "ZUNIONSTORE", "zz", ["1", "z"]),
        (14, "NOPE", "q", []),
    )
    log = spark.createDataFrame(rows, LOG)
    got = contents(replay(log))
    want = {k: (t, d.decode("latin-1") if isinstance(d, bytes) else d) for k, (t, d) in expected(by_model(rows)).items()}  # bytes travel as latin-1 text
    assert got == want and got["c"] == ("STRING", "A") and got["r"] == ("LIST", ["2"]) and "l" not in got and len(got["g"][1]) == 16
    assert [tuple(r) for r in unknown_commands(log).collect()] == [("NOPE", 1)]


def test_base_of_which_few_keys_are_touched(spark):
    t = at((0, "HSET", "h", ["f", "1"]), (0, "SET", "x", ["5"]), (0, "EXPIRE", "x", ["100"]), (0, "SADD", "m", ["a"]), (0, "EXPIRE", "m", ["10"]), (0, "RPUSH", "l", ["1"]), (0, "EXPIRE", "l", ["100"]), (0, "ZADD", "z", ["1", "a"]),
           (0, "EXPIRE", "z", ["100"]), (0, "SET", "y", ["1"]), (0, "EXPIRE", "y", ["100"]), (0, "HSET", "u", ["f", "v"]), (0, "EXPIRE", "u", ["50"]), (0, "SET", "n", ["1"]))
    tail = at((20, "INCR", "x", []), (20, "SADD", "m", ["b"]), (30, "RPUSH", "l", ["2"]), (30, "ZREM", "z", ["a"]), (31, "ZADD", "z", ["2", "b"]), (32, "SET", "y", ["2"]), (33, "SETNX", "n", ["9"]), (33, "SETNX", "o", ["9"]), (34, "INCRBY", "o", ["2"]), (35, "SETNX", "o", ["1"]))
    tail = [(100 + s, *r) for s, *r in tail]
    base = replay(spark.createDataFrame(t, LOG))
    ks = replay(spark.createDataFrame(tail, LOG), base)
    model = by_model(t + tail)
    assert contents(ks) == expected(model)
    assert {r["key"]: r["expire_at"] for r in ks.meta.collect() if r["expire_at"] is not None} == model.ends
    assert expected(model)["m"] == ("SET", {"b"}) and "z" not in model.ends and "l" in model.ends and expected(model)["o"] == ("STRING", "11")


def test_a_log_folds_without_python(spark):
    rows = at((0, "SET", "a", ["1"]), (1, "SETNX", "a", ["2"]), (2, "SETNX", "b", ["2"]), (3, "INCR", "b", []))
    ks = replay(spark.createDataFrame(rows, LOG))
    assert "FlatMapGroupsInPandas" not in ks.strings._jdf.queryExecution().toString() and contents(ks) == {"a": ("STRING", "1"), "b": ("STRING", "3")}


def test_values():
    values = [None, 7, -3, SimpleString("OK"), WireError("ERR no"), b"\x00\r\n", [1, [b"x", None], []], b""]
    data = b"".join(map(encode_value, values))
    got = list(decode_values(data))
    assert got == values and isinstance(got[3], SimpleString) and isinstance(got[4], WireError)
    assert list(decode_values(b"*-1\r\n$-1\r\n")) == [None, None]
    for cut in range(1, len(data)):
        part = list(decode_values(data[:cut]))
        assert part == values[: len(part)]
    for bad in (b"?1\r\n", b"$3\r\nabcde\r\n", b":x\r\n", b"$-2\r\n"):
        with pytest.raises(ValueError):
            list(decode_values(bad))
    with pytest.raises(ValueError):
        list(decode_commands(encode_value([1, 2])))


def test_wire_log_round_trip(spark, tmp_path):
    from keyloom.sources.storage import read_wire_files

    rows = random_log(300, 5)
    path = str(tmp_path / "wire")
    files = write_wire_log(spark.createDataFrame(rows, LOG).repartition(3), path)
    assert files.agg({"commands": "sum"}).first()[0] == 300
    (tmp_path / "wire" / "log-000000-lost.aof").write_bytes(encode_command("SET", "lost", ["1"])[:-4])  # of an attempt that does not count
    back = sorted((r["file"], r["n"], r["cmd"], r["key"], r["args"]) for r in read_wire_files(spark, path).collect())
    assert [b[2:] for b in back] == [(cmd, key, args) for _, _, cmd, key, args in rows]


def test_rewritten_log(spark, tmp_path):
    from keyloom.sources.storage import read_wire_files

    rows = at((0, "HSET", "h", [x for i in range(3000) for x in (f"f{i}", str(i))]), (1, "SADD", "s", ["a", "b", "ñ"]), (2, "RPUSH", "l", [str(i) for i in range(1500)]), (3, "ZADD", "z", ["1.5", "a", "2", "b"]), (4, "SET", "x", ["y"]), (5, "EXPIRE", "x", ["9"]), (6, "SET", "gone", ["1"]), (7, "EXPIRE", "gone", ["1"]))
    ks = replay(spark.createDataFrame(rows, LOG))
    rewrite_log(ks, str(tmp_path / "log"), now_ms=last_ms(rows) + 2000)
    back = read_wire_files(spark, str(tmp_path / "log")).collect()
    assert len(back) <= 4 + 1 + 2 + 1 + 2 and {"1.5", "2"} <= {a for r in back if r["cmd"] == "ZADD" for a in r["args"]}
    again = spark.createDataFrame([(i, rows[0][1], r["cmd"], r["key"], r["args"]) for i, r in enumerate(sorted(back, key=lambda r: (r["file"], r["n"])))], LOG)
    want = contents(ks)
    del want["gone"]
    assert contents(replay(again)) == want


def test_scores_as_text(spark):
    got = spark.createDataFrame([(0, 1.0), (1, -3.0), (2, 2.5), (3, float("inf")), (4, float("-inf")), (5, 0.1), (6, 1e300), (7, -0.0)], "id int, s double").select("id", score_text(F.col("s")).alias("t"))
    assert [r["t"] for r in got.orderBy("id").collect()] == ["1", "-3", "2.5", "inf", "-inf", "0.1", "1.0E300", "0"]


def test_wire():
    data = encode_command("SET", "k", [b"\x00\xff", "ñ"]) + encode_command("DEL", "k", [])
    assert list(decode_commands(data)) == [[b"SET", b"k", b"\x00\xff", "ñ".encode()], [b"DEL", b"k"]]
    assert list(decode_commands(data[:-3])) == [[b"SET", b"k", b"\x00\xff", "ñ".encode()]]


def test_wire_files(spark, tmp_path):
    from keyloom.sources.storage import read_wire_files

    (tmp_path / "a.aof").write_bytes(encode_command("rpush", "l", ["a", "b"]) * 2)
    rows = read_wire_files(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r["n"], r["cmd"], r["key"], r["args"]) for r in rows] == [(0, "RPUSH", "l", ["a", "b"]), (1, "RPUSH", "l", ["a", "b"])]
