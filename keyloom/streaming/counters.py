"""Running counters and leaderboards over the command log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.staging import fresh_path


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream, its zone-less time as UTC time for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counters(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """INCR and INCRBY by event type and window; rows later than ``delay`` are left out."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(at.alias("w"), F.concat(F.lit("cnt:"), "event_type").alias("key")).agg(F.count("*").alias("count"), F.sum(F.floor("value").cast("long")).alias("total"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("count"))


def daily_counters_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream a whole table through daily counters into Parquet, batch by batch, and merge what each batch adds."""
    where = fresh_path(spark, "stream")
    rows = read_events(spark, sf_dir).withColumn("day", F.to_date("ts"))

    def put(batch: DataFrame, epoch: int) -> None:
        # A repeated batch overwrites its own folder: the sums stay right.
        added = batch.groupBy(F.concat(F.lit("cnt:"), "event_type").alias("key"), "day").agg(F.count("*").alias("count"), F.sum(F.floor("value").cast("long")).alias("total"))
        added.write.mode("overwrite").parquet(f"{where}/parts/batch={epoch}")

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    parts = spark.read.parquet(f"{where}/parts")
    return parts.groupBy("key", "day").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def follow_log(log: DataFrame, keyspace_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Replication by log: of each micro-batch the keys it touches are folded onto the last snapshot and saved as a layer over it.

    A batch at or before the manifest's position was applied before a restart and is skipped.
    """
    from ..plans.replay import replay, replay_onto
    from ..sources.storage import Snapshots

    def put(batch: DataFrame, epoch: int) -> None:
        shots = Snapshots(batch.sparkSession, keyspace_path)
        done = shots.manifest()["seq"]
        fresh = batch if done is None else batch.filter(F.col("seq") > done)
        last = fresh.agg(F.max("seq")).first()[0]
        if last is not None:
            base = shots.load()
            shots.save(replay(fresh), last) if base is None else shots.append(*replay_onto(fresh, base), last)

    writer = log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def leaderboard_batches(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ZINCRBY as a stream: batches of member sums in Parquet, each overwriting its own folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy(F.concat(F.lit("spend:"), "event_type").alias("key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("member")).agg(F.sum(F.round(F.col("value") * 10000).cast("long")).alias("units"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """The sorted sets that the batches so far add up to."""
    rows = spark.read.parquet(path).groupBy("key", "member").agg(F.sum("units").alias("units"))
    return rows.select("key", "member", (F.col("units").cast("double") / 10000.0).alias("score"))
