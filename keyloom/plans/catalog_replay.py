"""Queries over replayed logs, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables as t
from ..sources.staging import fresh_path
from ..sources.storage import Snapshots
from ..streaming import counters
from .replay import replay


def _log(spark, sf_dir, prefix: str):
    return t.command_log(spark, sf_dir).filter(F.col("key").startswith(prefix))


VALUE = "CAST(CAST(round(value * 10000) AS BIGINT) AS VARCHAR)"


@query(f"""WITH e AS (SELECT 's:' || user_id AS key, max_by(event_type, event_id) AS last, max_by({VALUE}, event_id) AS value FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1)
  SELECT key, value FROM e WHERE last = 'signup'""")
def replay_strings(spark, sf_dir):
    return replay(_log(spark, sf_dir, "s:")).strings


@query("SELECT 'z:' || (user_id % 10) AS key, 'u' || user_id AS member, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) AS score FROM events WHERE event_type = 'view' GROUP BY ALL")
def replay_zset(spark, sf_dir):
    return replay(_log(spark, sf_dir, "z:")).zsets


@query("""WITH e AS (SELECT event_id, 'h:' || (user_id % 20) AS key, 'u' || user_id AS field, event_type FROM events),
  d AS (SELECT key, field, max(event_id) AS gone FROM e WHERE event_type = 'error' GROUP BY ALL)
  SELECT e.key, e.field, CAST(count(*) AS VARCHAR) AS value FROM e LEFT JOIN d ON e.key = d.key AND e.field = d.field WHERE event_type <> 'error' AND (gone IS NULL OR event_id > gone) GROUP BY ALL""")
def replay_hash(spark, sf_dir):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    drop = F.col("event_type") == "error"
    log = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.when(drop, "HDEL").otherwise("HINCRBY").alias("cmd"), F.expr("concat('h:', user_id % 20)").alias("key"), F.when(drop, F.array(user)).otherwise(F.array(user, F.lit("1"))).alias("args"))
    return replay(log).hashes


@query("""WITH e AS (SELECT event_id, 'm:' || (event_id % 50) AS key, user_id::VARCHAR AS member, event_type FROM events WHERE event_type IN ('click', 'error'))
  SELECT key, member FROM e GROUP BY ALL HAVING max_by(event_type, event_id) = 'click'""")
def replay_set(spark, sf_dir):
    log = t.read(spark, sf_dir, "events").filter("event_type IN ('click', 'error')")
    return replay(log.select(F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "click", "SADD").otherwise("SREM").alias("cmd"), F.expr("concat('m:', event_id % 50)").alias("key"), F.array(F.col("user_id").cast("string")).alias("args"))).sets


@query(f"""WITH e AS (SELECT event_id, 'l:' || user_id AS key, event_type, {VALUE} AS value, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events WHERE event_type IN ('click', 'purchase')),
  r AS (SELECT key, max_by(s, event_id) - least(0, min(s)) AS n FROM e GROUP BY key),
  p AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS back FROM e WHERE event_type = 'click')
  SELECT p.key, CAST(n - back AS BIGINT) AS pos, value FROM p JOIN r ON p.key = r.key WHERE back <= n""")
def replay_list(spark, sf_dir):
    return replay(_log(spark, sf_dir, "l:")).lists


@query(f"SELECT 'l:' || user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS place, {VALUE} AS value FROM events WHERE event_type = 'click'")
def replay_pushes(spark, sf_dir):
    from ..operators.lists import lrange

    return lrange(replay(_log(spark, sf_dir, "l:").filter("cmd = 'RPUSH'")).lists, 0, -1).select("key", "place", "value")


@query("""WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'click') AS first, max(event_id) FILTER (event_type = 'click') AS last, max(event_id) FILTER (event_type = 'purchase') AS moved FROM events GROUP BY 1)
  SELECT 'in:' || (user_id % 50) AS key, user_id::VARCHAR AS member FROM f WHERE last IS NOT NULL AND (moved IS NULL OR last > moved)
  UNION ALL SELECT 'out:' || (user_id % 50), user_id::VARCHAR FROM f WHERE moved > first""")
def replay_multikey(spark, sf_dir):
    """A click puts a user into a set, and a purchase moves them to another, if they are there."""
    e = t.read(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase')")
    user, place = F.col("user_id").cast("string"), F.expr("user_id % 50").cast("string")
    click = F.col("event_type") == "click"
    args = F.when(click, F.array(user)).otherwise(F.array(F.concat(F.lit("out:"), place), user))
    return replay(e.select(F.col("event_id").alias("seq"), "ts", F.when(click, "SADD").otherwise("SMOVE").alias("cmd"), F.concat(F.lit("in:"), place).alias("key"), args.alias("args"))).sets


@query("SELECT 'z:' || (user_id % 10) AS key, 'u' || user_id AS member, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) AS score FROM events WHERE event_type = 'view' GROUP BY ALL")
def replay_snapshot_tail(spark, sf_dir):
    """The first half of a log as a saved snapshot, and the rest replayed onto it."""
    log = _log(spark, sf_dir, "z:")
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    shots = Snapshots(spark, fresh_path(spark, "snapshots"))
    shots.save(replay(log.filter(F.col("seq") <= half)), seq=half)
    return replay(log.filter(F.col("seq") > shots.manifest()["seq"]), shots.load()).zsets


@query("SELECT 'cnt:' || event_type AS key, ts::DATE AS day, count(*) AS count, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_counters(spark, sf_dir):
    """The daily counters that the stream ends with, once it has read all there is."""
    return counters.daily_counters_of_table(spark, sf_dir)


@query("SELECT 'spend:' || event_type AS key, 'u' || user_id AS member, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / 10000::DOUBLE AS score FROM events GROUP BY ALL")
def stream_leaderboard(spark, sf_dir):
    """The sorted sets that a stream of increments ends with."""
    where = fresh_path(spark, "leaderboard")
    counters.leaderboard_batches(counters.read_events(spark, sf_dir), f"{where}/sums", f"{where}/log").awaitTermination()
    return counters.leaderboard(spark, f"{where}/sums")
