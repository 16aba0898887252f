"""Keyspaces derived from the analytic tables, as relations in long format with text values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant at which time-dependent queries look: 2024-01-15T00:00:00Z.
NOW_MS = 1_705_276_800_000
DAY_MS = 86_400_000
HALF = "2024-01-16"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, *columns: str) -> F.Column:
    parts = [F.lit(prefix)]
    for k, c in enumerate(columns):
        parts += ([F.lit(":")] if k else []) + [F.col(c).cast("string")]
    return F.concat(*parts)


def epoch_ms(ts: str = "ts") -> F.Column:
    """Milliseconds of a zone-less time as UTC, whatever the session's zone."""
    return F.expr(f"datediff(cast({ts} as date), date'1970-01-01') * 86400000L + (hour({ts}) * 3600 + minute({ts}) * 60) * 1000L + cast(extract(second from {ts}) * 1000 as bigint)")


def documents(spark, sf_dir) -> DataFrame:
    """Strings ``doc:{id}``."""
    return read(spark, sf_dir, "documents").select(named("doc:", "doc_id").alias("key"), F.col("text").alias("value"))


def counters(spark, sf_dir) -> DataFrame:
    """Deltas (key, seq, delta) of ``cnt:{event_type}``: the value's whole part."""
    return read(spark, sf_dir, "events").select(named("cnt:", "event_type").alias("key"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("delta"))


def customers(spark, sf_dir) -> DataFrame:
    """Hashes ``cust:{id}`` of name, segment, nation and balance in cents."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    each = F.map_from_arrays(F.array(*map(F.lit, ("name", "segment", "nation", "cents"))), F.array(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), cents))
    return read(spark, sf_dir, "customer").select(named("cust:", "c_custkey").alias("key"), F.explode(each).alias("field", "value"))


def user_actions(spark, sf_dir) -> DataFrame:
    """Hash deltas (key, field, delta) of ``user:{id}``: one per event, by type."""
    return read(spark, sf_dir, "events").select(named("user:", "user_id").alias("key"), F.col("event_type").alias("field"), F.lit(1).cast("long").alias("delta"))


def leaderboard(spark, sf_dir) -> DataFrame:
    """Sorted sets ``lb:{segment}`` of customers by balance."""
    return read(spark, sf_dir, "customer").select(named("lb:", "c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def spending(spark, sf_dir) -> DataFrame:
    """Sorted sets ``spend:{a|b}:{event_type}`` of users by value, before and from the middle of the month."""
    half = F.when(F.col("ts") < F.lit(HALF).cast("timestamp_ntz"), "a").otherwise("b")
    rows = read(spark, sf_dir, "events").withColumn("half", half).groupBy(named("spend:", "half", "event_type").alias("key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("member"))
    return rows.agg((F.sum(F.round(F.col("value") * 10000).cast("long")).cast("double") / 10000.0).alias("score"))


def active(spark, sf_dir) -> DataFrame:
    """Sets ``active:{event_type}:{date}`` of users."""
    rows = read(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return rows.select(named("active:", "event_type", "d").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()


def bitmaps(spark, sf_dir) -> DataFrame:
    """Bitmaps ``bm:{event_type}:{date}``: a bit per user."""
    rows = read(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return rows.select(named("bm:", "event_type", "d").alias("key"), F.col("user_id").alias("bit")).distinct()


def queues(spark, sf_dir) -> DataFrame:
    """Lists ``q:{user}`` of event types by event."""
    return read(spark, sf_dir, "events").select(named("q:", "user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("value"))


def sessions(spark, sf_dir) -> DataFrame:
    """Metadata of ``sess:{event}``: a day to live, sign-ups without an end."""
    end = F.when(F.col("event_type") != "signup", epoch_ms() + DAY_MS)
    return read(spark, sf_dir, "events").select(named("sess:", "event_id").alias("key"), F.lit("STRING").alias("type"), end.alias("expire_at"))


def command_log(spark, sf_dir) -> DataFrame:
    """Events as commands (seq, ts, cmd, key, args), in the order of event_id."""
    cmd = F.create_map(*[F.lit(x) for x in ("signup", "SET", "click", "RPUSH", "view", "ZINCRBY", "purchase", "LPOP", "error", "DEL")])[F.col("event_type")]
    value = F.round(F.col("value") * 10000).cast("long").cast("string")
    user = F.col("user_id").cast("string")
    args = F.when(cmd == "ZINCRBY", F.array(value, F.concat(F.lit("u"), user))).when(cmd.isin("SET", "RPUSH"), F.array(value)).otherwise(F.array().cast("array<string>"))
    kind = F.when(cmd.isin("RPUSH", "LPOP"), "l:").when(cmd == "ZINCRBY", "z:").otherwise("s:")
    place = F.when(cmd == "ZINCRBY", F.pmod("user_id", F.lit(10)).cast("string")).otherwise(user)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts"), cmd.alias("cmd"), F.concat(kind, place).alias("key"), args.alias("args"))
