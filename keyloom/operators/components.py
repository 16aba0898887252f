"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are rewired towards the smallest node they know until nothing changes; the number of rounds grows
with the logarithm of the components' size. Every round is staged in the shared folder, so nothing of
the graph comes to the driver and a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node with more neighbours than this is a hub; there are at most so many times fewer hubs than edges, and they are broadcast.
HUB = 1_000_000


def _moved(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``low`` of u. The edges of hubs are not dealt by their hub, which would bring them to one task."""
    hubs = low.filter(F.col("n") > HUB).select("u", "low")
    plain = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.filter(F.col("n") <= HUB).select("u", "low"), "u")
    return plain.unionByName(edges.join(F.broadcast(hubs), "u"))


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Each neighbour larger than a node moves to the smallest node of that neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
    named = _moved(both, low) if hubs else both.join(low.drop("n"), "u")
    return named.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    named = _moved(down, low) if hubs else down.join(low.drop("n"), "u")
    moved = named.select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame], max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v), any direction, repeats and loops allowed -> (node, component); ``stage`` writes a table and reads it back.

    Only nodes with an edge to another node are returned; component is the smallest node reachable.
    Raises if ``max_rounds`` do not suffice rather than returning unfinished components.
    """
    now = stage(edges.select("u", "v").filter("u != v").distinct(), "components-0")
    hubs = now.count() > HUB  # fewer edges have no hub
    mark = None
    for k in range(max_rounds):
        now = stage(_small_star(_large_star(now, hubs), hubs), f"components-{k + 1}")
        # At rest every component is a star; the sum over a fixed hash tells whether a round changed anything.
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = seen
    raise RuntimeError("components did not settle")
