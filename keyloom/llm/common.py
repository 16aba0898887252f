"""What the operators of this subpackage share: staged tables, names that do not clash, and the memory of workers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space as the contracts name it, and a run of everything else.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_RUN = "[^\\x20\\x09-\\x0D]+"

_CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Bytes of an Arrow batch between the JVM and Python while a table is staged: a task holds a batch on both sides, and long texts fill large ones.
_BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Session settings under which a task holds few long texts at a time: in Arrow batches, in Parquet's batches when it reads, in row groups when it writes. No effect on results.
SMALL_BATCHES = {_BATCH_CONF: 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024, "parquet.block.size": 8 << 20}
_staged: list[tuple[SparkSession, str]] = []
_kept: dict[object, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset (a local
    session, as in tests) a temporary folder of this machine is taken and remembered.
    """
    conf = spark.sparkContext.getConf().get(_CHECKPOINT_CONF) or spark.conf.get("keyloom.local.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CHECKPOINT_CONF} must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("keyloom.local.dir", conf)
        atexit.register(__import__("shutil").rmtree, conf, True)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/keyloom/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_staged)
    _staged.append((spark, path))
    return path


def _remove_staged() -> None:
    for spark, path in _staged:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before: nothing is left to remove it with
            return


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged path on whatever file system holds it."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None without the file."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which must not be there yet."""
    fs, at = _file_system(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    A lost executor costs no recomputation beyond this table: its files stay in the shared folder.
    Arrow batches hold ``BATCH_BYTES`` at most, or what the session has if that is less.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, min(BATCH_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> dict[str, str | None]:
    """Put ``SMALL_BATCHES`` in force; returns what ``put_back`` takes."""
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)
    return before


def put_back(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def kept(key, make: Callable):
    """``make()``, which a worker process keeps from task to task until it keeps another thing or ``let_go`` is called."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go(only_kept: bool = False) -> None:
    """Drop what this process keeps, and give the memory it has freed back to the machine: a worker lives on after its stage.

    ``only_kept``: nothing is done where nothing was kept, as in the functions of groups, which are called often.
    """
    if only_kept and not _kept:
        return
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` of a mapInArrow, with nothing kept from the stages before, and nothing left behind for those after."""

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from run(batches)
        finally:
            let_go()

    return leanly


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__kl_{n}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
