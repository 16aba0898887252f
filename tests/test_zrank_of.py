"""ZRANK of every member: the ranks of a sort, without forming the pairs of a key."""

from pyspark.sql import functions as F

from keyloom.operators import zsets
from keyloom.sources.staging import stage


def joined_rows(spark):
    """The most rows that a join of the last query put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for k in range(nodes.size()):
        node = nodes.apply(k)
        for m in range(node.metrics().size()):
            metric = node.metrics().apply(m)
            if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_every_member(spark):
    n = 3000
    z = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("key"), F.concat(F.lit("m"), F.col("id")).alias("member"), F.expr("cast(pmod(hash(id), 500) as double)").alias("score"))
    z = stage(z.unionByName(spark.range(700).selectExpr("'flat' AS key", "concat('m', id) AS member", "1.5D AS score")), "zrank")
    absent = spark.createDataFrame([("hot", "none"), ("nokey", "m1")], "key string, member string")
    got = zsets.zrank_of(z, z.select("key", "member").unionByName(absent)).collect()
    most = joined_rows(spark)
    want = {}
    for key, score, member in sorted((r["key"], r["score"], r["member"]) for r in z.collect()):
        want[key, member] = sum(k == key for k, _ in want)
    assert {(r["key"], r["member"]): r["rank"] for r in got} == want | {("hot", "none"): None, ("nokey", "m1"): None}
    assert 0 < most <= 2 * (n + 702)
