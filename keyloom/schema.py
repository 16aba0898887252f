"""The keyspace as a bundle of typed relations, and what holds for all of them.

A key has one type; a container without rows does not exist. Every relation is long-format, so that an
operator works on all keys at once and a key without rows vanishes by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "key string, type string, expire_at bigint"
STRING = "key string, value binary"
HASH = "key string, field string, value binary"
LIST = "key string, pos bigint, value binary"
SET = "key string, member binary"
ZSET = "key string, member string, score double"
LOG = "seq bigint, ts timestamp, cmd string, key string, args array<binary>"

WRONGTYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
NOT_INTEGER = "ERR value is not an integer or out of range"


class Applied(NamedTuple):
    """What a writing operator gives: the relation after it, and its replies."""

    state: DataFrame
    reply: DataFrame


@dataclass(frozen=True)
class Keyspace:
    """Relations of one logical database; ``meta`` has a row per key."""

    meta: DataFrame
    strings: DataFrame
    hashes: DataFrame
    lists: DataFrame
    sets: DataFrame
    zsets: DataFrame

    TYPES = {"STRING": "strings", "HASH": "hashes", "LIST": "lists", "SET": "sets", "ZSET": "zsets"}

    @classmethod
    def empty(cls, spark: SparkSession) -> Keyspace:
        return cls(*(spark.createDataFrame([], s) for s in (META, STRING, HASH, LIST, SET, ZSET)))

    def relations(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_(self, **relations: DataFrame) -> Keyspace:
        return replace(self, **relations)

    def live(self, now_ms: int) -> Keyspace:
        """Without the keys whose time is past; a key lives through its last millisecond."""
        meta = live(self.meta, now_ms)
        gone = self.meta.filter(F.col("expire_at") < now_ms).select("key")
        return Keyspace(meta, *(getattr(self, r).join(gone, "key", "left_anti") for r in self.TYPES.values()))

    def without(self, keys: DataFrame) -> Keyspace:
        """Without ``keys`` (key)."""
        return Keyspace(**{name: rel.join(keys, "key", "left_anti") for name, rel in self.relations().items()})

    def of_wrong_type(self, requests: DataFrame, expected: str) -> DataFrame:
        """``requests`` (key, ...) whose key holds another type, with ``error``."""
        other = self.meta.filter(F.col("type") != expected).select("key")
        return requests.join(other, "key", "left_semi").withColumn("error", F.lit(WRONGTYPE))


def live(meta: DataFrame, now_ms: int) -> DataFrame:
    return meta.filter(F.col("expire_at").isNull() | (F.col("expire_at") >= now_ms))
