"""Durable forms of a keyspace: versioned Parquet snapshots, the command log, and its wire text."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Keyspace


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that may not be there; of a folder with few."""
    fs, at = _fs(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


class Snapshots:
    """Versions of a keyspace below ``path``; the manifest names the layers of the current one and the log position it holds.

    A version is a whole keyspace, or a layer: the keys that changed and what they hold now. A version's content is
    its last whole keyspace with the layers since over it; after ``LAYERS`` of them a whole one is written again.
    """

    LAYERS = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        """What the last complete manifest says. Each version has a manifest of its own, written beside and then named:
        no manifest is ever replaced, so a crash at any point leaves the one before."""
        done = sorted(int(n.split("-")[1].split(".")[0]) for n in _names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json"))
        return json.loads(_read_text(self.spark, f"{self.path}/manifest-{done[-1]:012d}.json")) if done else {"version": 0, "seq": None}

    def _point(self, version: int, about: dict) -> None:
        fs, beside = _fs(self.spark, f"{self.path}/.manifest-{version:012d}.new")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        _, at = _fs(self.spark, f"{self.path}/manifest-{version:012d}.json")
        if fs.exists(at) or not fs.rename(beside, at):
            raise RuntimeError(f"version {version} was saved by another writer")

    def save(self, ks: Keyspace, seq: int | None = None, now_ms: int | None = None) -> int:
        """Write a new version, without the keys past their time, then point the manifest at it.

        Sorted sets are sorted within files by key and score, and the other relations by key, so that reads of
        few keys or of score ranges skip most row groups.
        """
        ks = ks if now_ms is None else ks.live(now_ms)
        version = self.manifest()["version"] + 1
        self._write(ks, version)
        self._point(version, {"version": version, "seq": seq, "layers": [version]})
        return version

    def append(self, touched: DataFrame, ks: Keyspace, seq: int | None = None) -> int:
        """Write a layer: ``touched`` (key) hold what they hold in ``ks`` and nothing else, all other keys are as before."""
        about = self.manifest()
        if not about["version"]:
            return self.save(ks, seq)
        version = about["version"] + 1
        self._write(ks, version)
        touched.select("key").distinct().write.mode("overwrite").parquet(f"{self.path}/v{version}/touched")
        self._point(version, {"version": version, "seq": seq, "layers": [*about["layers"], version]})
        return self.save(self.load(), seq) if len(about["layers"]) >= self.LAYERS else version

    def _write(self, ks: Keyspace, version: int) -> None:
        order = {"zsets": ["key", "score"], "lists": ["key", "pos"]}
        for name, rel in ks.relations().items():
            rel.sortWithinPartitions(*order.get(name, ["key"])).write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")

    def load(self, now_ms: int | None = None) -> Keyspace | None:
        about = self.manifest()
        if not about["version"]:
            return None
        read = lambda v, name: self.spark.read.parquet(f"{self.path}/v{v}/{name}")
        whole = lambda v: Keyspace(**{name: read(v, name) for name in ("meta", "strings", "hashes", "lists", "sets", "zsets")})
        *below, top = about["layers"]
        ks, over = whole(top), None
        for v in reversed(below):  # from the newest down: a layer shows where none above it has touched
            changed = read(v + 1, "touched") if over is None else over.unionByName(read(v + 1, "touched")).distinct()
            ks = ks.with_(**{name: rel.unionByName(shown) for (name, rel), shown in zip(ks.relations().items(), whole(v).without(changed).relations().values())})
            over = changed
        return ks if now_ms is None else ks.live(now_ms)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all versions but the last ``keep`` and those that the current one is made of."""
        about = self.manifest()
        for v in sorted(set(range(1, about["version"] - keep + 1)) - set(about.get("layers", []))):
            for name in (f"manifest-{v:012d}.json", f"v{v}"):
                fs, at = _fs(self.spark, f"{self.path}/{name}")
                fs.delete(at, True)


#: Snapshot rules as (seconds, changes): a save is due once both have been reached since the last one.
SAVE_RULES = ((900, 1), (300, 10), (60, 10_000))


def save_is_due(changes: int, seconds: float, rules=SAVE_RULES) -> bool:
    """Whether any rule asks for a snapshot after so many changes and more than so many seconds."""
    return any(changes >= least and seconds > after for after, least in rules)


def rewrite_is_due(log_bytes: int, base_bytes: int, seconds: float, least_bytes: int = 64 << 20, percentage: int = 100, pause: float = 60.0) -> bool:
    """Whether a log of so many bytes since the last rewrite, which left ``base_bytes``, is to be rewritten."""
    return seconds >= pause and log_bytes > least_bytes and log_bytes * 100 // max(1, base_bytes) >= percentage


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    log = spark.read.parquet(path)
    return log if after is None else log.filter(F.col("seq") > after)


# --- the wire text: simple strings, errors, integers, bulk strings and arrays of them ---------------


class WireError(str):
    """An error reply."""


class SimpleString(str):
    """A status reply."""


class _CutOff(Exception):
    """The data ends within a value."""


def encode_value(value) -> bytes:
    """A value's wire text: None, int, ``SimpleString``, ``WireError``, bytes, str, or a list of these."""
    if value is None:
        return b"$-1\r\n"
    if isinstance(value, int):
        return b":%d\r\n" % value
    if isinstance(value, (SimpleString, WireError)):
        return (b"+" if isinstance(value, SimpleString) else b"-") + value.encode() + b"\r\n"
    if isinstance(value, (list, tuple)):
        return b"*%d\r\n" % len(value) + b"".join(map(encode_value, value))
    raw = value if isinstance(value, bytes) else str(value).encode()
    return b"$%d\r\n%s\r\n" % (len(raw), raw)


def _value(data: bytes, at: int):
    """The value at ``at`` and where it ends."""
    end = data.find(b"\r\n", at)
    if end < 0:
        raise _CutOff
    kind, line, after = data[at : at + 1], data[at + 1 : end], end + 2
    if kind == b"+":
        return SimpleString(line.decode()), after
    if kind == b"-":
        return WireError(line.decode()), after
    if kind not in (b":", b"$", b"*"):
        raise ValueError(f"unknown type byte at {at}")
    n = int(line)
    if kind == b":":
        return n, after
    if n == -1:
        return None, after
    if kind == b"$":
        if after + n + 2 > len(data):
            raise _CutOff
        if n < 0 or data[after + n : after + n + 2] != b"\r\n":
            raise ValueError(f"a string at {at} is not framed by its length")
        return data[after : after + n], after + n + 2
    out = []
    for _ in range(n):
        item, after = _value(data, after)
        out.append(item)
    return out, after


def decode_values(data: bytes) -> Iterator:
    """The values of a wire text in turn; a cut-off last one is left out, anything else malformed raises."""
    at = 0
    while at < len(data):
        try:
            value, at = _value(data, at)
        except _CutOff:
            return
        yield value


def encode_command(cmd: str, key: str | None, args) -> bytes:
    parts = [cmd, *([] if key is None else [key]), *(args if args is not None else ())]
    return encode_value([p if isinstance(p, bytes) else str(p) for p in parts])


def decode_commands(data: bytes) -> Iterator[list[bytes]]:
    """The commands of a log file: arrays of bulk strings. A cut-off last one is left out, anything else raises."""
    for value in decode_values(data):
        if not isinstance(value, list) or not value or not all(isinstance(p, bytes) for p in value):
            raise ValueError("a log holds commands only")
        yield value


def write_wire_log(log: DataFrame, path: str) -> DataFrame:
    """Export a log (seq, cmd, key, args) as files of wire text below ``path``; (file, commands, bytes), a row per file.

    ``seq`` ascends within a file and over the files in the order of their names. Each attempt of a task writes files
    of its own, and the manifest, written last, names those that count. ``path`` is a folder that all tasks mount.
    """
    from .staging import stage

    spark = log.sparkSession
    fs, at = _fs(spark, path)
    uri = fs.makeQualified(at).toUri().toString()
    if not uri.startswith("file:"):
        raise ValueError(f"tasks cannot write to {uri}")
    folder = "/" + uri.removeprefix("file:").lstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, count, size = f"log-{task.partitionId():06d}-{task.taskAttemptId():012d}.aof", 0, 0
        out = None
        for b in batches:
            for cmd, key, args in zip(*(b.column(c).to_pylist() for c in range(3))):
                if out is None:
                    os.makedirs(folder, exist_ok=True)
                    out = open(f"{folder}/{name}", "wb")
                count, size = count + 1, size + out.write(encode_command(cmd, key, args))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["file", "commands", "bytes"])

    lines = log.repartitionByRange("seq").sortWithinPartitions("seq").select("cmd", "key", "args")
    files = stage(lines.mapInArrow(run, "file string, commands long, bytes long"), "wire-files")
    files.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return files


def read_wire_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of wire text as (file, n, cmd, key, args): ``n`` counts the commands of a file.

    Of a folder with a manifest only the files it names are read. Bytes that are no UTF-8 come out as latin-1 text.
    """

    def text(x: bytes) -> str:
        try:
            return x.decode()
        except UnicodeDecodeError:
            return x.decode("latin-1")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = [(name, n, p[0].decode().upper(), text(p[1]) if len(p) > 1 else None, [text(x) for x in p[2:]]) for n, p in enumerate(decode_commands(bytes(content)))]
                yield pd.DataFrame(rows, columns=["file", "n", "cmd", "key", "args"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.aof").load(path).select("path", "content")
    if _names(spark, f"{path}/_manifest"):
        named = spark.read.schema("file string").json(f"{path}/_manifest")
        files = files.join(named, F.substring_index("path", "/", -1) == F.col("file"), "left_semi")
    return files.mapInPandas(parsed, "file string, n long, cmd string, key string, args array<string>")


def rewrite_log(ks: Keyspace, path: str, now_ms: int | None = None) -> DataFrame:
    """The least log that makes ``ks``, without the keys past their time, as files of wire text: a command a key, long containers in several."""
    from ..plans.replay import as_commands

    return write_wire_log(as_commands(ks if now_ms is None else ks.live(now_ms), per_command=1000), path)
