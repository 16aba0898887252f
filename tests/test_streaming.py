"""Streams that read all there is equal the batch result of the same rows."""

from pyspark.sql import functions as F

from keyloom.streaming import blocking, counters

ROWS = "key string, seq bigint, ts_ms bigint, kind string, value string, timeout_ms bigint"


def simulate(rows):
    """Deadlines kept exactly, one waiter one answer."""
    out, state = set(), {}
    for key, seq, ts, kind, value, timeout in sorted(rows, key=lambda r: r[1]):
        items, waiters = state.setdefault(key, ([], []))
        for w in [w for w in waiters if w[1] < ts]:
            waiters.remove(w)
            out.add((key, w[0], None, "timeout"))
        if kind == "push":
            items.append((seq, value))
        else:
            waiters.append((seq, ts + timeout if timeout else 1 << 62, kind))
        while items and waiters:
            w = waiters.pop(0)
            out.add((key, w[0], items.pop(0 if w[2] == "pop-left" else -1)[0], "match"))
    return out


def test_blocking_queue(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(f"q{rng.randrange(3)}", i, 1_000_000 + i * 1000, rng.choice(["push", "pop-left", "pop-right"]), f"v{i}", rng.choice([0, 5000])) for i in range(120)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "0 seconds")
    q = blocking.match_blocking(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["wait_seq"], r["item_seq"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = simulate(rows)
    assert {g for g in got if g[3] == "match"} == {w for w in want if w[3] == "match"}
    assert want <= got
    assert len({g[:2] for g in got}) == len(got)  # timers may add the timeouts of idle keys, once each


def test_windows_and_follow(spark, tmp_path):
    from conftest import SF

    events = counters.read_events(spark, SF)
    q = counters.windowed_counters(events, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "w")).option("checkpointLocation", str(tmp_path / "wc")).trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "w"))
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.concat(F.lit("cnt:"), "event_type").alias("key"), F.to_date("ts").alias("d")).count()
    joined = done.select("key", F.to_date("w.start").alias("d"), F.col("count").alias("n")).join(batch, ["key", "d"])
    assert joined.count() == done.count() > 0 and joined.filter("n != count").isEmpty()


def test_follow_log(spark, tmp_path):
    from test_replay import LOG, by_model, contents, expected, last_ms, random_log

    from keyloom.sources.storage import Snapshots

    rows = random_log(120, 9)
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    counters.follow_log(stream, str(tmp_path / "ks"), str(tmp_path / "check")).awaitTermination()
    assert contents(Snapshots(spark, str(tmp_path / "ks")).load(last_ms(rows))) == expected(by_model(rows))


LIST_ROWS = "key string, seq bigint, ts_ms bigint, kind string, lists array<string>, value string, target string, timeout_ms bigint"


def simulate_lists(rows):
    """Matches (key, waiter, list, item) by looking at every waiter again after every change."""
    out, state = set(), {}
    for key, seq, ts, kind, names, value, target, timeout in sorted(rows, key=lambda r: r[1]):
        lists, waiters = state.setdefault(key, ({}, []))
        waiters[:] = [w for w in waiters if w[1] >= ts]
        if kind.startswith("push"):
            own = lists.setdefault(names[0], [])
            lists[names[0]] = [(seq, value), *own] if kind == "push-left" else [*own, (seq, value)]
        else:
            waiters.append((seq, ts + timeout if timeout else 1 << 62, kind, names, target))
        changed = True
        while changed:
            changed = False
            for w in waiters:
                name = next((n for n in w[3] if lists.get(n)), None)
                if name is not None:
                    item = lists[name].pop(0 if w[2] == "pop-left" else -1)
                    out.add((key, w[0], name, item[0], item[1], w[4]))
                    if w[4] is not None:
                        lists.setdefault(w[4], []).insert(0, item)
                    waiters.remove(w)
                    changed = True
                    break
    return out


def test_moves_wake_those_who_wait_on_their_target(spark, tmp_path):
    import random

    rng = random.Random(7)
    rows = [("a", 0, 0, "pop-right", ["x"], None, "y", 0), ("a", 1, 1000, "pop-left", ["y"], None, "z", 0), ("a", 2, 2000, "pop-left", ["w", "z"], None, None, 0), ("a", 3, 3000, "push-left", ["x"], "v", None, 0)]
    for i in range(10, 200):
        kind = rng.choice(["push-left", "push-right", "pop-left", "pop-right"])
        names = rng.sample(["p", "q", "r"], 1 if kind.startswith("push") else rng.randint(1, 3))
        target = rng.choice([None, None, "p", "q", "s"]) if kind == "pop-right" and len(names) == 1 else None
        rows.append((f"g{rng.randrange(3)}", i, i * 1000, kind, names, f"v{i}" if kind.startswith("push") else None, None if target in names else target, rng.choice([0, 4000])))
    rows = [(key, seq, 1_000_000 + ts, *rest) for key, seq, ts, *rest in rows]  # a row at the epoch would be late
    spark.createDataFrame(rows, LIST_ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LIST_ROWS).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "0 seconds")
    blocking.match_lists(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    matches = {(r["key"], r["wait_seq"], r["list"], r["item_seq"], r["value"], r["target"]) for r in got if r["outcome"] == "match"}
    assert matches == simulate_lists(rows)
    assert {("a", 0, "x", 3, "v", "y"), ("a", 1, "y", 3, "v", "z"), ("a", 2, "z", 3, "v", None)} <= matches  # one push answers three clients
    assert len({(r["key"], r["wait_seq"]) for r in got}) == len(got)
