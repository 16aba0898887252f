"""Queries over sorted sets, and the cursor scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranges import ScoreRange
from ..operators import scan, zsets
from ..registry import query
from ..sources import tables as t

LB = "z AS (SELECT 'lb:' || c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"
SPEND = """z AS (SELECT 'spend:' || (CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END) || ':' || event_type AS key, 'u' || user_id AS member,
  CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / 10000::DOUBLE AS score FROM events GROUP BY ALL)"""
UP = "row_number() OVER (PARTITION BY key ORDER BY score, member)"
DOWN = "row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC)"


def _bonus(spark, sf_dir):
    """A hundred points for every customer, and newcomers; (key, member, score, seq)."""
    rows = t.read(spark, sf_dir, "customer")
    key = t.named("lb:", "c_mktsegment").alias("key")
    old = rows.select(key, F.col("c_name").alias("member"), (F.col("c_acctbal") + 100).alias("score"), F.col("c_custkey").alias("seq"))
    return old.unionByName(rows.select(key, F.concat(F.lit("new:"), F.col("c_name")).alias("member"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("seq")))


BONUS = """w AS (SELECT 'lb:' || c_mktsegment AS key, unnest([c_name, 'new:' || c_name]) AS member, unnest([c_acctbal + 100, c_acctbal]) AS score FROM customer)"""


@query(f"WITH {LB}, {BONUS} SELECT key, count(*) AS added FROM w WHERE (key, member) NOT IN (SELECT (key, member) FROM z) GROUP BY key")
def zadd(spark, sf_dir):
    return zsets.zadd(t.leaderboard(spark, sf_dir), _bonus(spark, sf_dir)).reply


@query(f"WITH {LB}, {BONUS} SELECT coalesce(w.key, z.key) AS key, coalesce(w.member, z.member) AS member, coalesce(w.score, z.score) AS score FROM z FULL JOIN w ON z.key = w.key AND z.member = w.member")
def zadd_state(spark, sf_dir):
    return zsets.zadd(t.leaderboard(spark, sf_dir), _bonus(spark, sf_dir)).state


@query(f"WITH {LB}, {BONUS} SELECT w.key, w.member, coalesce(z.score, 0) + w.score AS score FROM w LEFT JOIN z ON z.key = w.key AND z.member = w.member")
def zincrby(spark, sf_dir):
    return zsets.zincrby(t.leaderboard(spark, sf_dir), _bonus(spark, sf_dir).select("key", "member", F.col("score").alias("delta"))).reply


@query(f"WITH {LB}, {BONUS} SELECT w.key, w.member, z.score FROM w LEFT JOIN z ON z.key = w.key AND z.member = w.member")
def zscore(spark, sf_dir):
    return zsets.zscore(t.leaderboard(spark, sf_dir), _bonus(spark, sf_dir).select("key", "member"))


@query(f"WITH {LB} SELECT key, count(*) AS card FROM z GROUP BY key")
def zcard(spark, sf_dir):
    return zsets.zcard(t.leaderboard(spark, sf_dir))


@query(f"WITH {LB} SELECT key, count(*) FILTER (score > 1000 AND score <= 5000) AS count FROM z GROUP BY key")
def zcount(spark, sf_dir):
    z = t.leaderboard(spark, sf_dir)
    return zsets.zcount(z, z.select("key").distinct(), ScoreRange.parse("(1000", "5000"))


@query(f"WITH {LB} SELECT key, member, score, place - 1 AS place FROM (SELECT *, {UP} AS place FROM z) WHERE place <= 10")
def zrange(spark, sf_dir):
    return zsets.zrange(t.leaderboard(spark, sf_dir), 0, 9)


@query(f"WITH {LB} SELECT key, member, score, n - back AS place FROM (SELECT *, {DOWN} AS back, count(*) OVER (PARTITION BY key) AS n FROM z) WHERE back BETWEEN 2 AND 5")
def zrange_neg(spark, sf_dir):
    return zsets.zrange(t.leaderboard(spark, sf_dir), -5, -2)


@query(f"WITH {LB} SELECT key, member, score, place - 1 AS place FROM (SELECT *, {DOWN} AS place FROM z) WHERE place <= 10")
def zrevrange(spark, sf_dir):
    return zsets.zrevrange(t.leaderboard(spark, sf_dir), 0, 9)


@query(f"WITH {LB} SELECT key, member, score FROM (SELECT *, {UP} AS place FROM z WHERE score >= 0 AND score < 4000) WHERE place BETWEEN 6 AND 15")
def zrangebyscore(spark, sf_dir):
    return zsets.zrangebyscore(t.leaderboard(spark, sf_dir), ScoreRange.parse("0", "(4000"), 5, 10)


@query(f"WITH {LB} SELECT key, member FROM z WHERE NOT (key, member) IN (SELECT ('lb:' || c_mktsegment, c_name) FROM customer WHERE c_custkey % 7 = 0)")
def zrem(spark, sf_dir):
    gone = t.read(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(t.named("lb:", "c_mktsegment").alias("key"), F.col("c_name").alias("member"))
    return zsets.zrem(t.leaderboard(spark, sf_dir), gone).state.select("key", "member")


@query(f"WITH {LB} SELECT key, member, score FROM (SELECT *, {UP} AS place, count(*) OVER (PARTITION BY key) AS n FROM z) WHERE NOT place - 1 BETWEEN 10 AND n - 11")
def zremrangebyrank(spark, sf_dir):
    return zsets.zremrangebyrank(t.leaderboard(spark, sf_dir), 10, -11).state


@query(f"WITH {LB} SELECT key, count(*) AS removed FROM z WHERE score < 0 GROUP BY key")
def zremrangebyscore(spark, sf_dir):
    return zsets.zremrangebyscore(t.leaderboard(spark, sf_dir), ScoreRange.parse("-inf", "(0")).reply


def _halves(z):
    """Groups (dest, key, weight): both halves of each event type, the second weighing 3 and the first 2."""
    kind = F.element_at(F.split("key", ":"), 3)
    return z.select(F.concat(F.lit("all:"), kind).alias("dest"), "key", F.when(F.col("key").startswith("spend:a"), 2.0).otherwise(3.0).alias("weight")).distinct()


def _store(how: str, fold: str):
    having = "HAVING count(*) = 2" if how == "inter" else ""
    sql = f"""WITH {SPEND} SELECT 'all:' || split_part(key, ':', 3) AS dest, member, round({fold}(score * CASE WHEN key LIKE 'spend:a%' THEN 2::DOUBLE ELSE 3::DOUBLE END), 4) AS score
      FROM z GROUP BY ALL {having}"""

    @query(sql, f"z{how}store_{fold}")
    def run(spark, sf_dir):
        z = t.spending(spark, sf_dir)
        op = zsets.zinter if how == "inter" else zsets.zunion
        return op(z, _halves(z), fold.upper()).withColumn("score", F.round("score", 4))


for _how in ("union", "inter"):
    for _fold in ("sum", "min", "max"):
        _store(_how, _fold)


@query(f"WITH {SPEND} SELECT 'all:' || split_part(key, ':', 3) AS key, count(DISTINCT member) AS size FROM z GROUP BY 1", "zunionstore_size")
def zunionstore_size(spark, sf_dir):
    z = t.spending(spark, sf_dir)
    groups = _halves(z)
    return zsets.store(z, zsets.zunion(z, groups), groups).reply


@query(f"WITH {LB} SELECT key, member, score, {UP} - 1 AS rank FROM z")
def zrank(spark, sf_dir):
    return zsets.zrank(t.leaderboard(spark, sf_dir))


@query(f"WITH {LB} SELECT key, member, score, {DOWN} - 1 AS rank FROM z")
def zrevrank(spark, sf_dir):
    return zsets.zrank(t.leaderboard(spark, sf_dir), reverse=True)


@query(f"WITH {LB}, r AS (SELECT *, {UP} - 1 AS rank FROM z) SELECT key, member, rank FROM r")
def zrank_of(spark, sf_dir):
    asked = t.read(spark, sf_dir, "customer").select(t.named("lb:", "c_mktsegment").alias("key"), F.col("c_name").alias("member"))
    return zsets.zrank_of(t.leaderboard(spark, sf_dir), asked)


@query(f"""WITH {LB} SELECT key, member, score, CASE WHEN n > 30 THEN 30 ELSE 0 END::BIGINT AS next_cursor FROM (SELECT *, {UP} AS place, count(*) OVER (PARTITION BY key) AS n FROM z)
  WHERE place BETWEEN 11 AND 30 AND regexp_full_match(member, '.*1.*')""")
def zscan(spark, sf_dir):
    return scan.zscan(t.leaderboard(spark, sf_dir), 10, 20, "*1*")


@query("""WITH s AS (SELECT DISTINCT 'active:' || event_type || ':' || ts::DATE AS key, user_id::VARCHAR AS member FROM events)
  SELECT key, member, CASE WHEN n > 15 THEN 15 ELSE 0 END::BIGINT AS next_cursor FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS place, count(*) OVER (PARTITION BY key) AS n FROM s)
  WHERE place BETWEEN 6 AND 15 AND regexp_full_match(member, '1.')""")
def sscan(spark, sf_dir):
    return scan.sscan(t.active(spark, sf_dir), 5, 10, "1?")


@query("""SELECT 'cust:' || c_custkey AS key, unnest(['cents', 'name']) AS field, unnest([CAST(round(c_acctbal * 100) AS BIGINT)::VARCHAR, c_name]) AS value, 2::BIGINT AS next_cursor FROM customer""")
def hscan(spark, sf_dir):
    return scan.hscan(t.customers(spark, sf_dir), 0, 2)


@query("SELECT key FROM (SELECT 'sess:' || event_id AS key FROM events WHERE 'sess:' || event_id > 'sess:5' ORDER BY 1 LIMIT 50) WHERE regexp_full_match(key, '.*7.*')", "scan")
def scan_(spark, sf_dir):
    return scan.scan(t.sessions(spark, sf_dir), "sess:5", 50, "*7*").select("key")
