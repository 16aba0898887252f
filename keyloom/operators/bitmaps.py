"""Bitmaps: the set bits as rows (key, bit), and the strings' lengths as (key, nbytes). Bit 0 is the first byte's highest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Applied

AT = ["key", "bit"]


def sizes_of(bits: DataFrame) -> DataFrame:
    """The shortest strings that hold ``bits``."""
    return bits.groupBy("key").agg((F.floor(F.max("bit") / 8) + 1).cast("long").alias("nbytes"))


def setbit(bits: DataFrame, sizes: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SETBIT over ``writes`` (key, bit, v, seq): the bits, the sizes, and the old bit of each place written."""
    last = writes.groupBy(*AT).agg(F.max_by("v", "seq").alias("v"))
    after = bits.join(last.select(*AT), AT, "left_anti").unionByName(last.filter("v = 1").select(*AT))
    grown = sizes.unionByName(writes.groupBy("key").agg((F.floor(F.max("bit") / 8) + 1).cast("long").alias("nbytes"))).groupBy("key").agg(F.max("nbytes").alias("nbytes"))
    old = last.select(*AT).join(bits.select(*AT, F.lit(1).alias("old")), AT, "left").withColumn("old", F.coalesce("old", F.lit(0)))
    return after, grown, old


def getbit(bits: DataFrame, requests: DataFrame) -> DataFrame:
    """GETBIT: 0 beyond the end and for absent keys."""
    return requests.join(bits.select(*AT, F.lit(1).alias("v")), AT, "left").withColumn("v", F.coalesce("v", F.lit(0)))


def bitcount(bits: DataFrame, sizes: DataFrame, start: int = 0, stop: int = -1) -> DataFrame:
    """BITCOUNT of every key over the bytes ``start..stop``, negative ones from the end."""
    n = F.col("nbytes")
    first = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    last = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    if (start, stop) == (0, -1):
        hits = bits
    else:
        byte = F.floor(F.col("bit") / 8)
        hits = bits.join(sizes, "key").filter((byte >= first) & (byte <= last))
    got = hits.groupBy("key").agg(F.count("*").alias("count"))
    return sizes.select("key").join(got, "key", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def bitpos(bits: DataFrame, keys: DataFrame, sizes: DataFrame, v: int) -> DataFrame:
    """BITPOS of each of ``keys``: the first bit equal to ``v``.

    Absent keys give 0 for a clear bit and -1 for a set one; a string of ones gives its length in bits. The
    first clear bit is the least place whose predecessor is set and which is not, found by joining.
    """
    if v == 1:
        return keys.join(bits.groupBy("key").agg(F.min("bit").alias("bitpos")), "key", "left").withColumn("bitpos", F.coalesce("bitpos", F.lit(-1).cast("long")))
    named = bits.join(keys.select("key"), "key", "left_semi")
    after = named.select("key", (F.col("bit") + 1).alias("bit")).unionByName(keys.select("key", F.lit(0).cast("long").alias("bit")))
    clear = after.join(named, AT, "left_anti").groupBy("key").agg(F.min("bit").alias("bitpos"))
    return keys.join(clear, "key", "left")


def bitop(bits: DataFrame, sizes: DataFrame, groups: DataFrame, op: str) -> tuple[DataFrame, DataFrame]:
    """BITOP over ``groups`` (dest, key): the bits (dest, bit) and the sizes (dest, nbytes) of the results.

    Short and absent sources are padded with clear bits. NOT takes one source and turns its own bytes.
    """
    named = groups.select("dest", "key").distinct()
    size = named.join(sizes, "key").groupBy("dest").agg(F.max("nbytes").alias("nbytes"))
    rows = named.join(bits, "key").select("dest", "key", "bit")
    if op == "OR":
        return rows.select("dest", "bit").distinct(), size
    if op == "XOR":
        return rows.groupBy("dest", "bit").agg(F.count("*").alias("__n")).filter("__n % 2 = 1").drop("__n"), size
    if op == "AND":
        wanted = named.groupBy("dest").agg(F.count("*").alias("__m"))
        have = rows.groupBy("dest", "bit").agg(F.count("*").alias("__n"))
        return have.join(wanted, "dest").filter("__n = __m").select("dest", "bit"), size
    if op == "NOT":
        # A byte at a time: places of one byte are made at once, so that a long string is spread over tasks.
        every = size.select("dest", F.explode(F.expr("sequence(0L, nbytes - 1)")).alias("__byte")).select("dest", F.explode(F.expr("sequence(__byte * 8, __byte * 8 + 7)")).alias("bit"))
        return every.join(rows.select("dest", "bit"), ["dest", "bit"], "left_anti"), size
    raise ValueError("syntax error")


def to_bytes(bits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dense strings (key, value) of bitmaps: each byte is summed from its bits, then bytes are put in order."""
    value = F.sum(F.expr("shiftleft(1, cast(7 - bit % 8 as int))")).cast("int")
    bytes_ = bits.groupBy("key", (F.col("bit") / 8).cast("long").alias("__byte")).agg(value.alias("__v"))
    parts = bytes_.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("__byte", F.lpad(F.hex("__v"), 2, "0")))).alias("__m"))
    places = F.when(F.col("nbytes") > 0, F.expr("sequence(0L, greatest(nbytes, 1) - 1)")).otherwise(F.array().cast("array<bigint>"))
    text = F.array_join(F.transform(places, lambda i: F.coalesce(F.try_element_at("__m", i), F.lit("00"))), "")
    return sizes.join(parts, "key", "left").withColumn("__m", F.coalesce("__m", F.create_map().cast("map<bigint,string>"))).select("key", F.unhex(text).alias("value"))


def from_bytes(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bits, sizes) of dense strings."""
    digit = F.conv(F.substring(F.hex("value"), F.col("__h").cast("int") + 1, F.lit(1)), 16, 2)
    nibbles = strings.filter(F.octet_length("value") > 0).select("key", "value", F.explode(F.expr("sequence(0, 2 * octet_length(value) - 1)")).alias("__h"))
    spread = nibbles.select("key", "__h", F.posexplode(F.split(F.lpad(digit, 4, "0"), "")).alias("__b", "__v")).filter("__v = '1'")
    return spread.select("key", (F.col("__h").cast("long") * 4 + F.col("__b")).alias("bit")), strings.select("key", F.octet_length("value").cast("long").alias("nbytes"))
