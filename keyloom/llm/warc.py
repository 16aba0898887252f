"""WARC archives: one gzip member per record, written by tasks, read back by a sequential reader.

Each attempt of a task writes archives under names of its own in the shared folder and returns the names.
They are staged by Spark, which keeps the names of the one attempt that counts, and exactly these archives are
read back: what a lost, repeated or speculative attempt left behind is never read. The reader takes an
archive in slices, inflates one member at a time, frames each record by its Content-Length and verifies its
digests; a revisit's digest is held against that of the response it names.

The folder is resolved on the driver by Hadoop's rules, so a path without a scheme means the same file system
to Spark and to the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, new_path, stage

#: An archive is closed when it holds this many compressed bytes.
ARCHIVE_BYTES = 16 << 20
SLICE = 1 << 16
#: Payloads that more pages have than this are looked up by a broadcast, of so many payloads at most.
HOT, BROADCAST = 1_000, 1_000_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PAGE = "urn:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed. A revisit holds the HTTP header alone and names the page it repeats."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    uri = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{_PAGE}{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member, the same bytes at any time."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def slices(archive: bytes) -> Iterator[bytes]:
    return (archive[at : at + SLICE] for at in range(0, len(archive), SLICE))


def read_members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated members of an archive that comes in slices; a cut-off or damaged one raises."""
    inflate, out, began = zlib.decompressobj(31), [], False
    for part in data:
        while part:
            out.append(inflate.decompress(part))
            part, began = inflate.unused_data, True
            if inflate.eof:
                yield b"".join(out)
                inflate, out, began = zlib.decompressobj(31), [], False
    if began:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict:
    """A record's headers, and ``payload_bytes``, ``payload_digest``, checked against its content."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("the payload does not match its digest")
    return fields | {"payload_bytes": size, "payload_digest": digest, "payload": payload}


def resolved(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Hadoop gives it. Raises where tasks could not open it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    _store(uri)
    return uri


def _store(uri: str):
    """(file system, path) of a resolved folder or archive; (None, path) on a mounted one."""
    if uri.startswith("file:"):
        return None, "/" + uri.removeprefix("file:").lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    store, at = _store(folder)
    if store is None:
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/{name}", "xb") as out:
            out.writelines(parts)
        return
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{name}") as out:
        for p in parts:
            out.write(p)


def _get(folder: str, name: str) -> Iterator[bytes]:
    """An archive in slices."""
    store, at = _store(folder)
    with open(f"{at}/{name}", "rb") if store is None else store.open_input_stream(f"{at}/{name}") as data:
        while part := data.read(SLICE):
            yield part


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row to ``folder`` (resolved) and return (archive, records), a row per archive.

    Its action writes, once for each run: stage it, and read the archives it names. Of rows with equal payloads
    of at least ``least`` bytes those of the smallest id are responses and the others revisit it; null ids
    revisit unless no equal payload has an id. A null payload is empty.
    """
    key, low, n, hot = fresh(pages.select(id_col, url_col, payload_col), "digest", "low", "n", "hot")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn(key, F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    # Only payloads that stand more than once are joined back.
    groups = stage(rows.select("id", key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(low), F.count("*").alias(n)).filter(F.col(n) > 1), "warc-groups")
    often = groups.filter(F.col(n) > HOT).select(F.col(key), F.col(low).alias(hot), F.lit(True).alias(n))
    if often.count() <= BROADCAST:  # there are at most a thousandth as many as pages
        rows = rows.join(F.broadcast(often), key, "left")
        groups = groups.filter(F.col(n) <= HOT)
    else:
        rows = rows.withColumn(hot, F.lit(None)).withColumn(n, F.lit(None))
    # Rows that have their answer, or ask for none, are dealt by their id and do not meet in one task.
    aside = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    rows = rows.withColumn(key, F.when(F.col(n).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(aside)).drop(n)
    marked = rows.join(groups.select(key, low), key, "left").withColumn(low, F.coalesce(low, hot))
    marked = marked.select("id", "url", "payload", F.col(low).alias("refers_to"), (F.col(low).isNotNull() & ~F.col("id").eqNullSafe(F.col(low))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k, held, size, count = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], 0, 0
        names, counts = [], []

        def close():
            nonlocal k, held, size, count
            names.append(f"{own}-{k:04d}.warc.gz")
            _put(folder, names[-1], held)
            counts.append(count)
            k, held, size, count = k + 1, [], 0, 0

        for b in batches:
            for i, url, payload, to, again in zip(*(b.column(c) for c in range(5))):
                held.append(member(record(i.as_py(), url.as_py(), payload.as_py(), to.as_py(), again.as_py())))
                size, count = size + len(held[-1]), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return marked.mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the ``archives`` (archive: names in the resolved ``folder``): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(field: str | None):
            return (field or "").strip("<>").removeprefix(_PAGE) or None

        for b in batches:
            for name in b.column(0).to_pylist():
                out, held = [], 0
                for data in read_members(_get(folder, name)):
                    f = parse(data)
                    response = f["warc-type"] == "response"
                    out.append((page(f["warc-record-id"]), f["warc-target-uri"], f["payload_bytes"], f["payload_digest"], f["warc-type"], page(f.get("warc-refers-to")), f["payload"] if response else None))
                    held += len(data)
                    if held > ARCHIVE_BYTES:
                        yield _batch(out)
                        out, held = [], 0
                yield _batch(out)

    got = archives.select("archive").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return got.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive): the names of all archives in a folder, for those that this program did not write."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.substring_index("path", "/", -1).alias("archive"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def unmatched_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose response is not there with the same digest and size; repeats are told once."""
    named = ["refers_to", "payload_digest", "payload_bytes"]
    asked = records.filter("record_type = 'revisit' AND refers_to IS NOT NULL").select(*named).distinct()
    return asked.join(records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *named[1:]), named, "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, a row per page. An empty table gives none."""
    spark = pages.sparkSession
    folder = resolved(spark, new_path(spark, "warc"))
    kind = pages.schema[id_col].dataType.simpleString()
    # Staged, so that the archives are written once; dealt one by one, as an archive is a task's work.
    written = stage(write_archives(pages, folder, id_col, url_col, payload_col, least), "warc-names")
    n = written.count()
    records = read_archives(written.repartition(max(1, n)), folder, kind).drop("payload", "url")
    records = stage(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    if not unmatched_revisits(records).isEmpty():
        raise ValueError("a revisit's payload digest is not that of its response")
    return records
