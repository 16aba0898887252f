"""Bitmaps and Bloom filters as the strings that hold them.

A bitmap's string is its bytes. A filter's string has its bits and its hashes as two 32-bit numbers, and then
its bits. Strings may be binary or text; text stands for its latin-1 bytes, or UTF-8 where a letter is beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from .bitmaps import from_bytes, to_bytes


def as_bytes(strings: DataFrame) -> DataFrame:
    """(key, value binary)."""
    if isinstance(strings.schema["value"].dataType, BinaryType):
        return strings.select("key", "value")
    narrow = F.col("value").rlike("^[\\x00-\\xFF]*\\z")
    return strings.select("key", F.when(narrow, F.encode("value", "ISO-8859-1")).otherwise(F.encode("value", "UTF-8")).alias("value"))


def as_values(strings: DataFrame, kind: DataType) -> DataFrame:
    """(key, value) of the relation's type, from bytes."""
    return strings if isinstance(kind, BinaryType) else strings.select("key", F.decode("value", "ISO-8859-1").alias("value"))


def bits_of(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bits, sizes) of the strings."""
    return from_bytes(as_bytes(strings))


def strings_of(bits: DataFrame, sizes: DataFrame, kind: DataType) -> DataFrame:
    return as_values(to_bytes(bits, sizes), kind)


def _number(value, at: int) -> F.Column:
    return F.conv(F.hex(F.substring(value, at, 4)), 16, 10).cast("long")


def filters_of(strings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filters (key, m, k), bits (key, pos), those that are no filter (key, error))."""
    raw = as_bytes(strings)
    fine = F.octet_length("value") >= 8
    filters = raw.filter(fine).select("key", _number(F.col("value"), 1).alias("m"), _number(F.col("value"), 5).alias("k"))
    bits, _ = from_bytes(raw.filter(fine).select("key", F.expr("substring(value, 9, octet_length(value))").alias("value")))
    return filters, bits.select("key", F.col("bit").alias("pos")), raw.filter(~fine).select("key", F.lit("ERR not a valid BloomFilter").alias("error"))


def strings_of_filters(filters: DataFrame, bits: DataFrame, kind: DataType) -> DataFrame:
    sizes = filters.select("key", F.floor((F.col("m") + 7) / 8).cast("long").alias("nbytes"))
    body = to_bytes(bits.select("key", F.col("pos").alias("bit")), sizes)
    head = F.unhex(F.concat(F.lpad(F.hex("m"), 8, "0"), F.lpad(F.hex("k"), 8, "0")))
    return as_values(filters.join(body, "key").select("key", F.concat(head, "value").alias("value")), kind)
