"""Blocking pops and expiring keys as stateful stream operators.

The state of a key is its waiting items and its waiting clients, first come first served. Rows of a
micro-batch are taken in the order of ``seq``; a client whose deadline is past by a row's time is timed
out before that row counts, and a timer flushes those of idle keys. A client is answered exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = StructType([StructField("key", StringType()), StructField("wait_seq", LongType()), StructField("item_seq", LongType()), StructField("value", StringType()), StructField("outcome", StringType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = 1 << 62


class BlockingQueue(StatefulProcessor):
    """Input rows (key, seq, ts_ms, kind: push, pop-left or pop-right, value, timeout_ms)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "seq bigint, value string")
        self.waiters = handle.getListState("waiters", "seq bigint, deadline bigint, side string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items, waiters, out = list(self.items.get()), list(self.waiters.get()), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            alive = []
            for w in waiters:
                if w[1] < r.ts_ms:
                    out.append((key[0], w[0], None, None, "timeout"))
                else:
                    alive.append(w)
            waiters = alive
            if r.kind == "push":
                items.append((r.seq, r.value))
            else:
                waiters.append((r.seq, NEVER if r.timeout_ms == 0 else r.ts_ms + r.timeout_ms, r.kind))
            while items and waiters:
                w = waiters.pop(0)
                item = items.pop(0 if w[2] == "pop-left" else -1)
                out.append((key[0], w[0], item[0], item[1], "match"))
        self._keep(items, waiters)
        for deadline in {w[1] for w in waiters if w[1] < NEVER}:
            self.handle.registerTimer(deadline + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, items, waiters = expiredTimerInfo.getExpiryTimeInMs(), list(self.items.get()), list(self.waiters.get())
        late = [w for w in waiters if w[1] < now]
        self._keep(items, [w for w in waiters if w[1] >= now])
        yield _frame([(key[0], w[0], None, None, "timeout") for w in late])

    def _keep(self, items, waiters) -> None:
        for state, rows in ((self.items, items), (self.waiters, waiters)):
            state.clear()
            if rows:
                state.put([tuple(r) for r in rows])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=OUT.names).astype({"wait_seq": "Int64", "item_seq": "Int64"})


def match_blocking(rows: DataFrame) -> DataFrame:
    """``rows``: a stream (key, seq, ts, ts_ms, kind, value, timeout_ms) with a watermark on ts. Keys of one client share ``key``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=BlockingQueue(), outputStructType=OUT, outputMode="append", timeMode="eventTime")


class ExpiringValue(StatefulProcessor):
    """The last value of each key until its time to live, in event time; emits set and expired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "value string, expire_at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            old = self.value.get()
            if old is not None and old[1] is not None and old[1] < r.ts_ms:
                out.append((key[0], None, None, old[0], "expired"))
                self.value.clear()
            end = None if r.timeout_ms == 0 else int(r.ts_ms + r.timeout_ms)
            self.value.update((r.value, end))
            out.append((key[0], r.seq, None, r.value, "set"))
            if end is not None:
                self.handle.registerTimer(end + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old, out = self.value.get(), []
        if old is not None and old[1] is not None and old[1] < expiredTimerInfo.getExpiryTimeInMs():
            out = [(key[0], None, None, old[0], "expired")]
            self.value.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def expiring_values(rows: DataFrame) -> DataFrame:
    """SET with EX over a stream of the same shape; kinds are ignored."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=ExpiringValue(), outputStructType=OUT, outputMode="append", timeMode="eventTime")


OUT_LISTS = StructType(
    [StructField("key", StringType()), StructField("wait_seq", LongType()), StructField("list", StringType()), StructField("item_seq", LongType()), StructField("value", StringType()), StructField("target", StringType()), StructField("outcome", StringType())]
)


class BlockingLists(StatefulProcessor):
    """Lists that belong together: clients that wait on several, and moves that wake those who wait on their target.

    Input rows (key, seq, ts_ms, kind, lists array, value, target, timeout_ms). ``push-left`` and ``push-right`` put
    the value on the first of ``lists``; ``pop-left`` and ``pop-right`` take from the first of ``lists`` that has an
    item, or wait on all of them; with a ``target`` what is taken goes to its head, which may wake another client, whose
    own target may wake a third. State is the items and the waiting clients of all lists of ``key``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "list string, seq bigint, value string")
        self.waiters = handle.getListState("waiters", "seq bigint, deadline bigint, kind string, lists array<string>, target string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lists: dict[str, list[tuple]] = {}
        for name, seq, value in self.items.get():
            lists.setdefault(name, []).append((seq, value))
        waiters, out = [tuple(w) for w in self.waiters.get()], []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            out += [_timed_out(key, w) for w in waiters if w[1] < r.ts_ms]
            waiters = [w for w in waiters if w[1] >= r.ts_ms]
            names = [str(x) for x in r.lists]
            if r.kind.startswith("push"):
                own = lists.setdefault(names[0], [])
                own.insert(0 if r.kind == "push-left" else len(own), (int(r.seq), r.value))
                woken = names[:1]
            else:
                waiters.append((int(r.seq), NEVER if r.timeout_ms == 0 else int(r.ts_ms + r.timeout_ms), r.kind, names, None if pd.isna(r.target) else r.target))
                woken = [n for n in names if lists.get(n)][:1]
            while woken:  # a move wakes the clients of its target before any other row counts
                name = woken.pop(0)
                while lists.get(name) and (w := next((w for w in waiters if name in w[3]), None)):
                    waiters.remove(w)
                    item = lists[name].pop(0 if w[2] == "pop-left" else -1)
                    out.append((key[0], w[0], name, item[0], item[1], w[4], "match"))
                    if w[4] is not None:
                        lists.setdefault(w[4], []).insert(0, item)
                        woken.append(w[4])
        self._keep([(n, s, v) for n, own in lists.items() for s, v in own], waiters)
        for deadline in {w[1] for w in waiters if w[1] < NEVER}:
            self.handle.registerTimer(deadline + 1)
        yield _list_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiters = expiredTimerInfo.getExpiryTimeInMs(), [tuple(w) for w in self.waiters.get()]
        self._keep([tuple(i) for i in self.items.get()], [w for w in waiters if w[1] >= now])
        yield _list_frame([_timed_out(key, w) for w in waiters if w[1] < now])

    def _keep(self, items, waiters) -> None:
        for state, rows in ((self.items, items), (self.waiters, waiters)):
            state.clear()
            if rows:
                state.put(rows)

    def close(self) -> None:
        pass


def _timed_out(key, waiter) -> tuple:
    return key[0], waiter[0], None, None, None, waiter[4], "timeout"


def _list_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=OUT_LISTS.names).astype({"wait_seq": "Int64", "item_seq": "Int64"})


def match_lists(rows: DataFrame) -> DataFrame:
    """``rows``: a stream of ``BlockingLists`` rows with a watermark on ts; lists that a command ties together share ``key``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=BlockingLists(), outputStructType=OUT_LISTS, outputMode="append", timeMode="eventTime")
