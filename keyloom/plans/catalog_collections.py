"""Queries over lists, sets, hashes, bitmaps and Bloom filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitmaps, bloom, hashes, lists, sets
from ..registry import query
from ..sources import tables as t

Q = "l AS (SELECT 'q:' || user_id AS key, event_id AS pos, event_type AS value FROM events)"
HEAD = "row_number() OVER (PARTITION BY key ORDER BY pos)"
TAIL = "row_number() OVER (PARTITION BY key ORDER BY pos DESC)"
ACT = "s AS (SELECT DISTINCT 'active:' || event_type || ':' || ts::DATE AS key, user_id::VARCHAR AS member FROM events)"
HSH = """h AS (SELECT 'cust:' || c_custkey AS key, unnest(['name', 'segment', 'nation', 'cents']) AS field,
  unnest([c_name, c_mktsegment, c_nationkey::VARCHAR, CAST(round(c_acctbal * 100) AS BIGINT)::VARCHAR]) AS value FROM customer)"""
BM = """b AS (SELECT DISTINCT 'bm:' || event_type || ':' || ts::DATE AS key, user_id AS bit FROM events),
  n AS (SELECT key, max(bit) // 8 + 1 AS nbytes FROM b GROUP BY key)"""

# --- lists ----------------------------------------------------------------------------------------


def _writes(spark, sf_dir):
    """Two values for each of the users, every third of whom has a new list."""
    users = t.read(spark, sf_dir, "events").select("user_id").distinct()
    key = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("new:"), F.col("user_id").cast("string"))).otherwise(t.named("q:", "user_id"))
    return users.select(key.alias("key"), F.posexplode(F.array(F.lit("x"), F.lit("y"))).alias("seq", "value")).select("key", "value", F.col("seq").cast("long"))


W = "w AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'new:' || user_id ELSE 'q:' || user_id END AS key FROM events)"


def _pushed(name: str, left: bool, only: bool):
    join = "JOIN" if only else "LEFT JOIN"
    ends = "SELECT key, 1 AS place, 'y' AS value FROM k UNION ALL SELECT key, 2, 'x' FROM k" if left else "SELECT key, n + 1 AS place, 'x' AS value FROM k UNION ALL SELECT key, n + 2, 'y' FROM k"
    shift = "+ 2" if left else ""
    sql = f"""WITH {Q}, {W}, c AS (SELECT key, count(*) AS n FROM l GROUP BY key), k AS (SELECT w.key, coalesce(n, 0) AS n FROM w {join} c ON w.key = c.key)
      SELECT key, CAST(place - 1 AS BIGINT) AS place, value FROM ({ends} UNION ALL SELECT l.key, {HEAD.replace('key ORDER', 'l.key ORDER')} {shift}, value FROM l JOIN k ON l.key = k.key)"""

    @query(sql, name)
    def run(spark, sf_dir):
        w = _writes(spark, sf_dir)
        state = lists.push(t.queues(spark, sf_dir), w, left, only).state
        return lists.lrange(state.join(w.select("key").distinct(), "key", "left_semi"), 0, -1).select("key", "place", "value")


_pushed("lpush", True, False)
_pushed("rpush", False, False)
_pushed("lpushx", True, True)
_pushed("rpushx", False, True)


@query(f"WITH {Q} SELECT key, place - 1 AS place, value FROM (SELECT *, {HEAD} AS place FROM l) WHERE place <= 2")
def lpop(spark, sf_dir):
    return lists.pop(t.queues(spark, sf_dir), 2).reply


@query(f"WITH {Q} SELECT key, place - 1 AS place, value FROM (SELECT *, {TAIL} AS place FROM l) WHERE place <= 2")
def rpop(spark, sf_dir):
    return lists.pop(t.queues(spark, sf_dir), 2, left=False).reply


@query(f"WITH {Q} SELECT key, count(*) AS length FROM l GROUP BY key")
def llen(spark, sf_dir):
    return lists.llen(t.queues(spark, sf_dir))


@query(f"WITH {Q} SELECT key, value FROM (SELECT *, {TAIL} AS back FROM l) WHERE back = 3")
def lindex(spark, sf_dir):
    return lists.lindex(t.queues(spark, sf_dir), -3)


@query(f"WITH {Q} SELECT key, pos, value, place - 1 AS place FROM (SELECT *, {HEAD} AS place FROM l) WHERE place <= 11")
def lrange(spark, sf_dir):
    return lists.lrange(t.queues(spark, sf_dir), 0, 10)


@query(f"WITH {Q} SELECT key, pos, value, n - back AS place FROM (SELECT *, {TAIL} AS back, count(*) OVER (PARTITION BY key) AS n FROM l) WHERE back BETWEEN 2 AND 5")
def lrange_neg(spark, sf_dir):
    return lists.lrange(t.queues(spark, sf_dir), -5, -2)


@query(f"WITH {Q} SELECT key, pos, CASE WHEN place = 2 THEN 'set' ELSE value END AS value FROM (SELECT *, {HEAD} AS place FROM l)")
def lset(spark, sf_dir):
    q = t.queues(spark, sf_dir)
    return lists.lset(q, q.select("key").distinct().withColumn("value", F.lit("set")), 1).state


@query(f"""WITH {Q}, p AS (SELECT key, min(pos) AS p FROM l WHERE value = 'purchase' GROUP BY key), a AS (SELECT key, pos::DOUBLE AS pos, value FROM l UNION ALL SELECT key, p - 0.5, 'in' FROM p)
  SELECT key, {HEAD} - 1 AS place, value FROM a""")
def linsert(spark, sf_dir):
    q = t.queues(spark, sf_dir)
    asked = q.select("key").distinct().select("key", F.lit("purchase").alias("pivot"), F.lit("in").alias("value"))
    return lists.lrange(lists.linsert(q, asked).state, 0, -1).select("key", "place", "value")


def _lrem(name: str, count: int):
    drop = {1: f"{HEAD.replace('key ', 'key, value ')} <= {count}", -1: f"{TAIL.replace('key ', 'key, value ')} <= {-count}", 0: "true"}[(count > 0) - (count < 0)]

    @query(f"WITH {Q} SELECT key, pos, value FROM (SELECT *, {drop} AS gone FROM l) WHERE NOT (value = 'click' AND gone)", name)
    def run(spark, sf_dir):
        q = t.queues(spark, sf_dir)
        return lists.lrem(q, q.select("key").distinct().withColumn("value", F.lit("click")), count).state


_lrem("lrem_head", 2)
_lrem("lrem_tail", -2)
_lrem("lrem_all", 0)


@query(f"WITH {Q} SELECT key, pos, value FROM (SELECT *, {HEAD} AS place, count(*) OVER (PARTITION BY key) AS n FROM l) WHERE place - 1 BETWEEN 1 AND n - 2")
def ltrim(spark, sf_dir):
    return lists.ltrim(t.queues(spark, sf_dir), 1, -2)


@query("""WITH w AS (SELECT 'q:' || user_id AS key, event_id AS wait_seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'view'),
  i AS (SELECT 'q:' || user_id AS key, event_id AS pos, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'click')
  SELECT w.key, wait_seq, pos, value FROM w LEFT JOIN i ON w.key = i.key AND w.r = i.r""")
def blpop_match(spark, sf_dir):
    q = t.queues(spark, sf_dir)
    return lists.blocking_match(q.filter("value = 'click'"), q.filter("value = 'view'").select("key", F.col("pos").alias("wait_seq")))


@query("""WITH w AS (SELECT 'q:' || user_id AS key, event_id AS wait_seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'view'),
  i AS (SELECT 'q:' || user_id AS key, event_id AS pos, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'click')
  SELECT w.key, wait_seq, pos, value FROM w LEFT JOIN i ON w.key = i.key AND w.r = i.r""")
def brpop_match(spark, sf_dir):
    q = t.queues(spark, sf_dir)
    return lists.blocking_match(q.filter("value = 'click'"), q.filter("value = 'view'").select("key", F.col("pos").alias("wait_seq")), from_left=False)


@query(f"""WITH {Q}, r AS (SELECT key, value FROM (SELECT *, {HEAD} AS place FROM l) WHERE place = 1), u AS (SELECT DISTINCT user_id FROM events)
  SELECT user_id AS request, coalesce(a.key, b.key) AS key, coalesce(a.value, b.value) AS value FROM u LEFT JOIN r a ON a.key = 'q:' || (user_id + 1) LEFT JOIN r b ON b.key = 'q:' || user_id WHERE coalesce(a.key, b.key) IS NOT NULL""")
def blpop_first(spark, sf_dir):
    users = t.read(spark, sf_dir, "events").select("user_id").distinct()
    asked = users.select(F.col("user_id").alias("request"), F.posexplode(F.expr("array('none', concat('q:', user_id + 1), concat('q:', user_id))")).alias("ord", "key"))
    return lists.first_of(t.queues(spark, sf_dir), asked)


@query(f"""WITH {Q}, m AS (SELECT DISTINCT user_id, 'q:' || user_id AS src FROM events), v AS (SELECT key, pos, value FROM (SELECT *, {TAIL} AS back FROM l) WHERE back = 1)
  SELECT user_id AS seq, src, 'done:' || (user_id % 5) AS dest, value FROM m JOIN v ON src = key""")
def brpoplpush(spark, sf_dir):
    users = t.read(spark, sf_dir, "events").select("user_id").distinct()
    moves = users.select(t.named("q:", "user_id").alias("src"), F.expr("concat('done:', user_id % 5)").alias("dest"), F.col("user_id").alias("seq"))
    return lists.rpoplpush(t.queues(spark, sf_dir), moves).reply


@query(f"""WITH {Q}, m AS (SELECT DISTINCT user_id, 'q:' || user_id AS src FROM events), o AS (SELECT *, {HEAD} AS place, {TAIL} AS back FROM l),
  n AS (SELECT 'done:' || (user_id % 5) AS key, row_number() OVER (PARTITION BY user_id % 5 ORDER BY user_id DESC) AS place, value FROM m JOIN o ON src = key WHERE back = 1)
  SELECT key, place - 1 AS place, value FROM o WHERE back > 1 UNION ALL SELECT key, place - 1, value FROM n""")
def brpoplpush_state(spark, sf_dir):
    users = t.read(spark, sf_dir, "events").select("user_id").distinct()
    moves = users.select(t.named("q:", "user_id").alias("src"), F.expr("concat('done:', user_id % 5)").alias("dest"), F.col("user_id").alias("seq"))
    return lists.lrange(lists.rpoplpush(t.queues(spark, sf_dir), moves).state, 0, -1).select("key", "place", "value")


# --- sets -----------------------------------------------------------------------------------------


def _newcomers(spark, sf_dir):
    """Members 100 to 160 for every set."""
    return t.active(spark, sf_dir).select("key").distinct().withColumn("member", F.explode(F.expr("transform(sequence(100, 160), x -> cast(x as string))")))


NEW = f"{ACT}, w AS (SELECT DISTINCT key, unnest(range(100, 161))::VARCHAR AS member FROM (SELECT DISTINCT key FROM s))"


@query(f"WITH {NEW} SELECT key, count(*) AS added FROM w WHERE (key, member) NOT IN (SELECT (key, member) FROM s) GROUP BY key")
def sadd(spark, sf_dir):
    return sets.sadd(t.active(spark, sf_dir), _newcomers(spark, sf_dir)).reply


@query(f"WITH {NEW} SELECT w.key, count(s.member) AS removed FROM w LEFT JOIN s ON s.key = w.key AND s.member = w.member GROUP BY w.key")
def srem(spark, sf_dir):
    return sets.srem(t.active(spark, sf_dir), _newcomers(spark, sf_dir)).reply


@query(f"WITH {ACT} SELECT key, count(*) AS card FROM s GROUP BY key")
def scard(spark, sf_dir):
    return sets.scard(t.active(spark, sf_dir))


@query(f"WITH {NEW} SELECT w.key, w.member, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS reply FROM w LEFT JOIN s ON s.key = w.key AND s.member = w.member")
def sismember(spark, sf_dir):
    return sets.sismember(t.active(spark, sf_dir), _newcomers(spark, sf_dir))


@query(f"WITH {ACT} SELECT key, member FROM s")
def smembers(spark, sf_dir):
    s = t.active(spark, sf_dir)
    return sets.smembers(s, s.select("key").distinct())


def _days(s):
    """Groups (dest, key, ord): the sets of a day, by event type."""
    parts = F.split("key", ":")
    return s.select(parts[2].alias("dest"), "key", parts[1].alias("ord")).distinct()


DAY = f"{ACT}, d AS (SELECT split_part(key, ':', 3) AS dest, split_part(key, ':', 2) AS kind, member FROM s), k AS (SELECT dest, count(DISTINCT kind) AS n, min(kind) AS first FROM d GROUP BY dest)"


@query(f"WITH {DAY} SELECT DISTINCT dest, member FROM d")
def sunion(spark, sf_dir):
    s = t.active(spark, sf_dir)
    return sets.sunion(s, _days(s))


@query(f"WITH {DAY} SELECT dest, member FROM d JOIN k USING (dest) GROUP BY dest, member, n HAVING count(*) = n")
def sinter(spark, sf_dir):
    s = t.active(spark, sf_dir)
    return sets.sinter(s, _days(s))


@query(f"WITH {DAY} SELECT dest, member FROM d JOIN k USING (dest) GROUP BY dest, member, first HAVING count(*) = 1 AND min(kind) = first")
def sdiff(spark, sf_dir):
    s = t.active(spark, sf_dir)
    return sets.sdiff(s, _days(s))


@query(f"WITH {DAY}, i AS (SELECT dest, member FROM d JOIN k USING (dest) GROUP BY dest, member, n HAVING count(*) = n) SELECT k.dest, least(count(i.member), 3) AS card FROM k LEFT JOIN i USING (dest) GROUP BY k.dest")
def sintercard(spark, sf_dir):
    s = t.active(spark, sf_dir)
    return sets.sintercard(s, _days(s), 3)


@query(f"WITH {DAY} SELECT key, member FROM s UNION ALL SELECT DISTINCT dest, member FROM d")
def sunionstore(spark, sf_dir):
    s = t.active(spark, sf_dir)
    return sets.store(s, sets.sunion(s, _days(s)))


@query(f"""WITH {ACT}, m AS (SELECT DISTINCT replace(key, 'click', 'view') AS dest, key AS src FROM s WHERE key LIKE 'active:click:%')
  SELECT m.src, m.dest, v.member, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS reply FROM m CROSS JOIN (VALUES ('1'), ('77'), ('none')) v(member) LEFT JOIN s ON s.key = m.src AND s.member = v.member""")
def smove(spark, sf_dir):
    s = t.active(spark, sf_dir)
    src = s.select(F.col("key").alias("src")).distinct().filter("src LIKE 'active:click:%'")
    moves = src.select("src", F.expr("replace(src, 'click', 'view')").alias("dest"), F.explode(F.array(F.lit("1"), F.lit("77"), F.lit("none"))).alias("member"))
    return sets.smove(s, moves).reply


@query(f"""WITH {ACT}, m AS (SELECT DISTINCT replace(key, 'click', 'view') AS dest, key AS src FROM s WHERE key LIKE 'active:click:%'),
  d AS (SELECT m.src, m.dest, s.member FROM m CROSS JOIN (VALUES ('1'), ('77'), ('none')) v(member) JOIN s ON s.key = m.src AND s.member = v.member)
  SELECT key, member FROM s WHERE (key, member) NOT IN (SELECT (src, member) FROM d) UNION SELECT dest, member FROM d""")
def smove_state(spark, sf_dir):
    s = t.active(spark, sf_dir)
    src = s.select(F.col("key").alias("src")).distinct().filter("src LIKE 'active:click:%'")
    moves = src.select("src", F.expr("replace(src, 'click', 'view')").alias("dest"), F.explode(F.array(F.lit("1"), F.lit("77"), F.lit("none"))).alias("member"))
    return sets.smove(s, moves).state.select("key", "member")


DRAW = "row_number() OVER (PARTITION BY key ORDER BY md5('{}|' || key || '|' || member), member)"


@query(f"WITH {ACT} SELECT key, member FROM (SELECT *, {DRAW.format(1)} AS r FROM s) WHERE r > 5")
def spop(spark, sf_dir):
    return sets.spop(t.active(spark, sf_dir), 5, seed=1).state


@query(f"WITH {ACT} SELECT key, member FROM (SELECT *, {DRAW.format(2)} AS r FROM s) WHERE r <= 5")
def srandmember(spark, sf_dir):
    return sets.srandmember(t.active(spark, sf_dir), 5, seed=2)


# --- hashes ---------------------------------------------------------------------------------------


def _fields(spark, sf_dir):
    """A new and an old field for every customer: (key, field, value, seq)."""
    rows = t.read(spark, sf_dir, "customer").select(t.named("cust:", "c_custkey").alias("key"), F.posexplode(F.array(F.lit("tier"), F.lit("segment"))).alias("seq", "field"))
    return rows.select("key", "field", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("value"), "seq")


FLD = f"{HSH}, w AS (SELECT 'cust:' || c_custkey AS key, unnest(['tier', 'segment']) AS field, unnest(['v0', 'v1']) AS value FROM customer)"


@query(f"WITH {FLD} SELECT coalesce(w.key, h.key) AS key, coalesce(w.field, h.field) AS field, coalesce(w.value, h.value) AS value FROM h FULL JOIN w ON h.key = w.key AND h.field = w.field")
def hset(spark, sf_dir):
    return hashes.hset(t.customers(spark, sf_dir), _fields(spark, sf_dir)).state


@query(f"WITH {FLD} SELECT key, 1::BIGINT AS added FROM w GROUP BY key", "hset_added")
def hset_added(spark, sf_dir):
    return hashes.hset(t.customers(spark, sf_dir), _fields(spark, sf_dir)).reply


@query(f"WITH {FLD} SELECT w.key, w.field, h.value FROM w LEFT JOIN h ON h.key = w.key AND h.field = w.field")
def hget(spark, sf_dir):
    return hashes.hget(t.customers(spark, sf_dir), _fields(spark, sf_dir).select("key", "field"))


@query("""SELECT 'cust:' || c_custkey AS key, unnest([0, 1, 2]) AS pos, unnest(['name', 'none', 'nation']) AS field, unnest([c_name, NULL, c_nationkey::VARCHAR]) AS value FROM customer""")
def hmget(spark, sf_dir):
    rows = t.read(spark, sf_dir, "customer").select(t.named("cust:", "c_custkey").alias("key"), F.posexplode(F.array(*map(F.lit, ("name", "none", "nation")))).alias("pos", "field"))
    return hashes.hmget(t.customers(spark, sf_dir), rows)


@query(f"WITH {HSH} SELECT key, field, value FROM h")
def hgetall(spark, sf_dir):
    h = t.customers(spark, sf_dir)
    return hashes.hgetall(h, h.select("key").distinct())


@query(f"WITH {FLD} SELECT key, field, value FROM h WHERE (key, field) NOT IN (SELECT (key, field) FROM w)")
def hdel(spark, sf_dir):
    return hashes.hdel(t.customers(spark, sf_dir), _fields(spark, sf_dir)).state


@query(f"WITH {HSH} SELECT key, count(*) AS length FROM h GROUP BY key")
def hlen(spark, sf_dir):
    return hashes.hlen(t.customers(spark, sf_dir))


@query(f"WITH {FLD} SELECT key, field, CASE WHEN field = 'tier' THEN 0 ELSE 1 END AS reply FROM w")
def hexists(spark, sf_dir):
    return hashes.hexists(t.customers(spark, sf_dir), _fields(spark, sf_dir).select("key", "field"))


@query("SELECT 'user:' || user_id AS key, event_type AS field, count(*) AS value FROM events GROUP BY ALL")
def hincrby(spark, sf_dir):
    deltas = t.user_actions(spark, sf_dir)
    none = deltas.select("key", "field", F.lit("").alias("value")).limit(0)
    return hashes.hincrby(none, deltas).reply.select("key", "field", "value")


@query(f"WITH {HSH} SELECT key, field FROM h")
def hkeys(spark, sf_dir):
    return hashes.hkeys(t.customers(spark, sf_dir))


@query(f"WITH {HSH} SELECT key, value FROM h")
def hvals(spark, sf_dir):
    return hashes.hvals(t.customers(spark, sf_dir))


# --- bitmaps --------------------------------------------------------------------------------------


def _bits(spark, sf_dir):
    b = t.bitmaps(spark, sf_dir)
    return b, bitmaps.sizes_of(b)


@query("""WITH w AS (SELECT 'bm:' || event_type AS key, user_id AS bit, max_by(event_id % 2, event_id) AS v FROM events GROUP BY ALL) SELECT key, bit FROM w WHERE v = 1""")
def setbit(spark, sf_dir):
    b = t.bitmaps(spark, sf_dir).limit(0)
    w = t.read(spark, sf_dir, "events").select(t.named("bm:", "event_type").alias("key"), F.col("user_id").alias("bit"), (F.col("event_id") % 2).alias("v"), F.col("event_id").alias("seq"))
    return bitmaps.setbit(b, bitmaps.sizes_of(b), w)[0]


@query("SELECT 'bm:' || event_type AS key, max(user_id) // 8 + 1 AS nbytes FROM events GROUP BY 1")
def setbit_size(spark, sf_dir):
    """Clear bits make a string longer too."""
    b = t.bitmaps(spark, sf_dir).limit(0)
    w = t.read(spark, sf_dir, "events").select(t.named("bm:", "event_type").alias("key"), F.col("user_id").alias("bit"), (F.col("event_id") % 2).alias("v"), F.col("event_id").alias("seq"))
    return bitmaps.setbit(b, bitmaps.sizes_of(b), w)[1]


@query(f"WITH {BM} SELECT split_part(key, ':', 3) AS dest, max(nbytes) AS nbytes FROM n GROUP BY 1")
def bitop_size(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.bitop(b, n, n.select(F.split("key", ":")[2].alias("dest"), "key"), "AND")[1]


@query(f"WITH {BM} SELECT n.key, r.bit, CASE WHEN b.key IS NULL THEN 0 ELSE 1 END AS v FROM n, unnest(range(nbytes * 8 + 8)) r(bit) LEFT JOIN b ON b.key = n.key AND b.bit = r.bit")
def getbit(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.getbit(b, n.select("key", F.explode(F.expr("sequence(0L, nbytes * 8 + 7)")).alias("bit")))


@query(f"WITH {BM} SELECT key, count(*) AS count FROM b GROUP BY key")
def bitcount(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.bitcount(b, n)


@query(f"WITH {BM} SELECT n.key, count(b.bit) AS count FROM n LEFT JOIN b ON b.key = n.key AND b.bit // 8 BETWEEN greatest(nbytes - 6, 0) AND nbytes - 2 GROUP BY n.key")
def bitcount_range(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.bitcount(b, n, -6, -2)


@query(f"WITH {BM} SELECT key, min(bit) AS bitpos FROM b GROUP BY key UNION ALL SELECT 'none', -1")
def bitpos1(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.bitpos(b, n.select("key").unionByName(spark.createDataFrame([("none",)], "key string")), n, 1)


@query(f"WITH {BM} SELECT key, min(r.p) AS bitpos FROM n, unnest(range(nbytes * 8 + 1)) r(p) WHERE (key, r.p) NOT IN (SELECT (key, bit) FROM b) GROUP BY key UNION ALL SELECT 'none', 0")
def bitpos0(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.bitpos(b, n.select("key").unionByName(spark.createDataFrame([("none",)], "key string")), n, 0)


def _bitop(op: str, having: str):
    sql = f"WITH {BM}, d AS (SELECT split_part(key, ':', 3) AS dest, key, bit FROM b), m AS (SELECT dest, count(DISTINCT key) AS m FROM d GROUP BY dest) SELECT dest, bit FROM d JOIN m USING (dest) GROUP BY dest, bit, m HAVING {having}"

    @query(sql, f"bitop_{op.lower()}")
    def run(spark, sf_dir):
        b, n = _bits(spark, sf_dir)
        groups = n.select(F.split("key", ":")[2].alias("dest"), "key")
        return bitmaps.bitop(b, n, groups, op)[0]


_bitop("AND", "count(*) = m")
_bitop("OR", "true")
_bitop("XOR", "count(*) % 2 = 1")


@query(f"WITH {BM}, e AS (SELECT key AS dest, unnest(range(nbytes * 8)) AS bit FROM n) SELECT dest, bit FROM e WHERE (dest, bit) NOT IN (SELECT (key, bit) FROM b)")
def bitop_not(spark, sf_dir):
    b, n = _bits(spark, sf_dir)
    return bitmaps.bitop(b, n, n.select(F.col("key").alias("dest"), "key"), "NOT")[0]


# --- Bloom filters --------------------------------------------------------------------------------

H = """i AS (SELECT 'bf:' || c_mktsegment AS key, c_name AS item, c_custkey AS seq FROM customer),
  p AS (SELECT key, item, seq, (('0x' || substr(md5(item), 1, 8))::BIGINT + k * ('0x' || substr(md5(item), 9, 8))::BIGINT) % 8192 AS pos FROM i CROSS JOIN (SELECT unnest(range(5)) AS k))"""


def _items(spark, sf_dir):
    return t.read(spark, sf_dir, "customer").select(t.named("bf:", "c_mktsegment").alias("key"), F.col("c_name").alias("item"), F.col("c_custkey").alias("seq"))


def _no_filters(spark):
    return spark.createDataFrame([], "key string, m bigint, k bigint"), spark.createDataFrame([], "key string, pos bigint")


@query("SELECT DISTINCT 'bf:' || c_mktsegment AS key, 8192::BIGINT AS m, 5::BIGINT AS k FROM customer")
def bf_reserve(spark, sf_dir):
    asked = _items(spark, sf_dir).select("key", F.lit(8192).cast("long").alias("m"), F.lit(5).cast("long").alias("k")).distinct()
    return bloom.reserve(_no_filters(spark)[0], asked).state


@query(f"WITH {H}, f AS (SELECT key, pos, min(seq) AS seq FROM p GROUP BY ALL) SELECT i.key, i.item, i.seq, CASE WHEN (i.key, i.seq) IN (SELECT (key, seq) FROM f) THEN 1 ELSE 0 END AS added FROM i")
def bf_add(spark, sf_dir):
    return bloom.add(*_no_filters(spark), _items(spark, sf_dir), "md5")[2].select("key", "item", "seq", "added")


@query("""WITH i AS (SELECT 'bf:' || c_mktsegment AS key, c_name AS item, c_custkey AS seq FROM customer),
  q AS (SELECT key, item FROM i UNION ALL SELECT key, item || '?' FROM i UNION ALL SELECT 'none', item FROM i),
  k AS (SELECT unnest(range(5)) AS k),
  b AS (SELECT DISTINCT key, (('0x' || substr(md5(item), 1, 8))::BIGINT + k * ('0x' || substr(md5(item), 9, 8))::BIGINT) % 8192 AS pos FROM i CROSS JOIN k WHERE seq % 2 = 0),
  p AS (SELECT key, item, (('0x' || substr(md5(item), 1, 8))::BIGINT + k * ('0x' || substr(md5(item), 9, 8))::BIGINT) % 8192 AS pos FROM q CROSS JOIN k)
  SELECT p.key, item, CASE WHEN count(DISTINCT b.pos) = count(DISTINCT p.pos) THEN 1 ELSE 0 END AS reply FROM p LEFT JOIN b ON p.key = b.key AND p.pos = b.pos GROUP BY p.key, item""")
def bf_exists(spark, sf_dir):
    items = _items(spark, sf_dir)
    filters, bits, _ = bloom.add(*_no_filters(spark), items.filter("seq % 2 = 0"), "md5")
    asked = items.select("key", "item").unionByName(items.select("key", F.concat("item", F.lit("?")).alias("item"))).unionByName(items.select(F.lit("none").alias("key"), "item"))
    return bloom.exists(filters, bits, asked, "md5")


@query(name="bf_murmur")
def bf_murmur(spark, sf_dir):
    """The exact hash's filters; a rows-only check, as SQL has no Murmur3."""
    return bloom.add(*_no_filters(spark), _items(spark, sf_dir))[1]
