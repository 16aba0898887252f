"""Queries over strings, counters, keys and their time to live."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys, strings
from ..registry import query
from ..schema import live
from ..sources import tables as t
from ..sources.tables import NOW_MS as NOW

STR = "s AS (SELECT 'doc:' || doc_id AS key, text AS value FROM documents)"
TTL = f"""m AS (SELECT 'sess:' || event_id AS key, 'STRING' AS type, CASE WHEN event_type <> 'signup' THEN epoch_us(ts) // 1000 + 86400000 END AS expire_at FROM events),
  a AS (SELECT * FROM m WHERE expire_at IS NULL OR expire_at >= {NOW})"""


def _asked(spark, sf_dir):
    """Every document's key, and as many of no document."""
    return t.read(spark, sf_dir, "documents").select(F.explode(F.array(t.named("doc:", "doc_id"), t.named("none:", "doc_id"))).alias("key"))


ASK = "k AS (SELECT unnest(['doc:' || doc_id, 'none:' || doc_id]) AS key FROM documents)"


@query(f"WITH {STR}, {ASK} SELECT k.key, value FROM k LEFT JOIN s ON k.key = s.key")
def get(spark, sf_dir):
    return strings.get(t.documents(spark, sf_dir), _asked(spark, sf_dir))


def _sets(spark, sf_dir):
    """Writes (key, value, seq): one per event to the key of its user's document."""
    return t.read(spark, sf_dir, "events").select(F.concat(F.lit("doc:"), (F.col("user_id") * 20).cast("string")).alias("key"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("seq"))


SETS = "w AS (SELECT 'doc:' || (user_id * 20) AS key, max_by('e' || event_id, event_id) AS value, min_by('e' || event_id, event_id) AS first FROM events GROUP BY ALL)"


@query(f"WITH {STR}, {SETS} SELECT coalesce(w.key, s.key) AS key, coalesce(w.value, s.value) AS value FROM s FULL JOIN w ON s.key = w.key")
def set_lww(spark, sf_dir):
    return strings.set_values(t.documents(spark, sf_dir), _sets(spark, sf_dir)).state


@query(f"WITH {STR}, {SETS} SELECT key, value FROM s UNION ALL SELECT key, first FROM w WHERE key NOT IN (SELECT key FROM s)")
def set_nx(spark, sf_dir):
    return strings.set_values(t.documents(spark, sf_dir), _sets(spark, sf_dir), "NX").state


@query(f"WITH {STR}, {SETS} SELECT key, CASE WHEN key IN (SELECT key FROM s) THEN 'OK' END AS reply FROM w")
def set_xx(spark, sf_dir):
    return strings.set_values(t.documents(spark, sf_dir), _sets(spark, sf_dir), "XX").reply


@query(f"WITH {STR}, {SETS} SELECT key, CASE WHEN key IN (SELECT key FROM s) THEN 0 ELSE 1 END AS reply FROM w")
def setnx(spark, sf_dir):
    s = t.documents(spark, sf_dir)
    return strings.setnx(s, s.select("key"), _sets(spark, sf_dir)).reply


@query(f"""WITH {TTL} SELECT key, type, CASE WHEN CAST(substr(key, 6) AS BIGINT) % 4 = 0 THEN NULL WHEN CAST(substr(key, 6) AS BIGINT) % 4 = 1 THEN {NOW + 5000} ELSE expire_at END AS expire_at FROM a
  WHERE CAST(substr(key, 6) AS BIGINT) % 4 <> 2""")
def getex(spark, sf_dir):
    meta = live(t.sessions(spark, sf_dir), NOW)
    values = meta.select("key", F.lit("v").alias("value"))
    n = F.expr("cast(substr(key, 6) as bigint) % 4")
    asked = meta.select("key", F.when(n == 1, F.lit(NOW + 5000)).when(n == 2, F.lit(NOW - 1)).alias("expire_at"), (n == 0).alias("persist"))
    return strings.getex(values, meta, asked, NOW).state.select("key", "type", "expire_at")


@query(f"WITH {TTL} SELECT key, 'v' AS value FROM a")
def getex_reply(spark, sf_dir):
    """The old value, whatever becomes of its end."""
    meta = live(t.sessions(spark, sf_dir), NOW)
    asked = meta.select("key", F.lit(NOW - 1).alias("expire_at"), F.lit(False).alias("persist"))
    return strings.getex(meta.select("key", F.lit("v").alias("value")), meta, asked, NOW).reply.select("key", "value")


@query(f"WITH {STR}, q AS (SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN 'doc:' || doc_id ELSE 'none' END AS key FROM documents) SELECT pos, q.key, value FROM q LEFT JOIN s ON q.key = s.key")
def mget(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents")
    return strings.mget(t.documents(spark, sf_dir), rows.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, t.named("doc:", "doc_id")).otherwise("none").alias("key")))


@query("SELECT 'k:' || (event_id % 100) AS key, max_by(event_type, event_id) AS value FROM events GROUP BY 1")
def mset(spark, sf_dir):
    w = t.read(spark, sf_dir, "events").select(F.expr("concat('k:', event_id % 100)").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return strings.mset(w.select("key", "value").limit(0), w).state


@query("WITH w AS (SELECT 'doc:' || user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS tail FROM events GROUP BY 1) SELECT key, octet_length(encode(coalesce(text, '') || tail))::INTEGER AS length FROM w LEFT JOIN documents ON key = 'doc:' || doc_id")
def append(spark, sf_dir):
    w = t.read(spark, sf_dir, "events").select(t.named("doc:", "user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return strings.append(t.documents(spark, sf_dir), w).reply


@query(f"""WITH {STR}, w AS (SELECT 'doc:' || user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS tail FROM events GROUP BY 1)
  SELECT coalesce(s.key, w.key) AS key, md5(CASE WHEN tail IS NULL THEN value ELSE coalesce(value, '') || tail END) AS digest FROM s FULL JOIN w ON s.key = w.key""")
def append_state(spark, sf_dir):
    w = t.read(spark, sf_dir, "events").select(t.named("doc:", "user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return strings.append(t.documents(spark, sf_dir), w).state.select("key", F.md5("value").alias("digest"))


@query(f"WITH {STR}, {SETS} SELECT key, md5(value) AS digest FROM s UNION ALL SELECT key, md5(first) FROM w WHERE key NOT IN (SELECT key FROM s)")
def setnx_state(spark, sf_dir):
    s = t.documents(spark, sf_dir)
    return strings.setnx(s, s.select("key"), _sets(spark, sf_dir)).state.select("key", F.md5("value").alias("digest"))


@query(f"WITH {STR}, {SETS} SELECT s.key, md5(coalesce(w.value, s.value)) AS digest FROM s LEFT JOIN w ON s.key = w.key")
def set_xx_state(spark, sf_dir):
    return strings.set_values(t.documents(spark, sf_dir), _sets(spark, sf_dir), "XX").state.select("key", F.md5("value").alias("digest"))


@query(f"WITH {STR}, {ASK} SELECT k.key, coalesce(octet_length(encode(value)), 0)::INTEGER AS length FROM k LEFT JOIN s ON k.key = s.key")
def strlen(spark, sf_dir):
    return strings.strlen(t.documents(spark, sf_dir), _asked(spark, sf_dir))


def _counter(name: str, delta: str, sql_delta: str):
    @query(f"SELECT 'cnt:' || event_type AS key, CAST(7 + sum({sql_delta}) AS BIGINT) AS value FROM events GROUP BY 1", name)
    def run(spark, sf_dir):
        deltas = t.counters(spark, sf_dir).withColumn("delta", F.expr(delta))
        start = deltas.select("key").distinct().withColumn("value", F.lit("7"))
        return strings.incr_by(start, deltas).reply.select("key", "value")


_counter("incr", "1", "1")
_counter("incrby", "delta", "CAST(floor(value) AS BIGINT)")
_counter("decr", "-1", "-1")
_counter("decrby", "-delta", "-CAST(floor(value) AS BIGINT)")


# --- keys -----------------------------------------------------------------------------------------


def _sessions(spark, sf_dir):
    """Every session's key, and as many of no session."""
    return t.read(spark, sf_dir, "events").select(F.explode(F.array(t.named("sess:", "event_id"), t.named("none:", "event_id"))).alias("key"))


EVERY = "r AS (SELECT unnest(['sess:' || event_id, 'none:' || event_id]) AS key FROM events)"


@query(f"WITH {TTL} SELECT key, type, expire_at FROM m WHERE CAST(substr(key, 6) AS BIGINT) % 3 <> 0", "del")
def del_(spark, sf_dir):
    from ..schema import Keyspace

    ks = Keyspace.empty(spark).with_(meta=t.sessions(spark, sf_dir))
    gone = t.read(spark, sf_dir, "events").filter("event_id % 3 = 0").select(t.named("sess:", "event_id").alias("key"))
    return keys.delete(ks, gone)[0].meta


@query(f"WITH {TTL} SELECT 2 * count(*) AS found FROM a")
def exists(spark, sf_dir):
    asked = _sessions(spark, sf_dir)
    return keys.exists(t.sessions(spark, sf_dir), asked.unionByName(asked), NOW)


def _expire(option: str, sql: str):
    @query(f"WITH {TTL}, r AS (SELECT unnest(['sess:' || event_id, 'none:' || event_id]) AS key, {NOW} + (event_id % 20) * 43200000 AS new FROM events) SELECT r.key, CASE WHEN a.key IS NOT NULL AND ({sql}) THEN 1 ELSE 0 END AS reply FROM r LEFT JOIN a ON r.key = a.key", f"expire_{option.lower()}")
    def run(spark, sf_dir):
        asked = t.read(spark, sf_dir, "events").select(F.explode(F.array(t.named("sess:", "event_id"), t.named("none:", "event_id"))).alias("key"), ((F.col("event_id") % 20) * 43200).alias("seconds"))
        return keys.expire(t.sessions(spark, sf_dir), asked, NOW, option).reply


@query(f"WITH {TTL} SELECT key, type, {NOW} + (CAST(substr(key, 6) AS BIGINT) % 20) * 43200000 AS expire_at FROM a")
def expire_state(spark, sf_dir):
    """Plain EXPIRE; what is due at once lives through this millisecond."""
    asked = t.read(spark, sf_dir, "events").select(t.named("sess:", "event_id").alias("key"), ((F.col("event_id") % 20) * 43200).alias("seconds"))
    return keys.expire(t.sessions(spark, sf_dir), asked, NOW).state.select("key", "type", "expire_at")


_expire("NX", "expire_at IS NULL")
_expire("XX", "expire_at IS NOT NULL")
_expire("GT", "expire_at IS NOT NULL AND new > expire_at")
_expire("LT", "expire_at IS NULL OR new < expire_at")


@query(f"WITH {TTL} SELECT m.key, CASE WHEN a.key IS NULL THEN -2 ELSE coalesce(a.expire_at - {NOW}, -1) END AS pttl FROM m LEFT JOIN a ON m.key = a.key")
def pttl(spark, sf_dir):
    meta = t.sessions(spark, sf_dir)
    return keys.pttl(meta, meta.select("key"), NOW)


@query(f"WITH {TTL} SELECT m.key, CASE WHEN a.key IS NULL THEN -2 WHEN a.expire_at IS NULL THEN -1 ELSE (a.expire_at - {NOW}) // 1000 END AS ttl FROM m LEFT JOIN a ON m.key = a.key")
def ttl(spark, sf_dir):
    meta = t.sessions(spark, sf_dir)
    return keys.ttl(meta, meta.select("key"), NOW)


@query(f"WITH {TTL} SELECT key, type, expire_at FROM a")
def live_keys(spark, sf_dir):
    return live(t.sessions(spark, sf_dir), NOW)


@query(f"WITH {TTL}, {EVERY} SELECT r.key, CASE WHEN expire_at IS NOT NULL THEN 1 ELSE 0 END AS reply FROM r LEFT JOIN a ON r.key = a.key")
def persist(spark, sf_dir):
    return keys.persist(t.sessions(spark, sf_dir), _sessions(spark, sf_dir), NOW).reply


@query(f"WITH {TTL} SELECT key, type, CAST(NULL AS BIGINT) AS expire_at FROM a")
def persist_state(spark, sf_dir):
    return keys.persist(t.sessions(spark, sf_dir), _sessions(spark, sf_dir), NOW).state.select("key", "type", "expire_at")


@query(f"WITH {TTL} SELECT type, count(*) AS keys, count(expire_at) AS expires FROM a GROUP BY type")
def keyspace_stats(spark, sf_dir):
    return keys.statistics(t.sessions(spark, sf_dir), NOW)
