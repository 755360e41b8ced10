"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (partial aggregation on the map side, so a node with a
third of all edges costs one row per task) and a join back, whose hot keys adaptive
execution splits. Each round's edges are written to the shared folder; the driver sees
only their count and checksum. Rounds needed grow with the logarithm of the longest chain."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grown, stage


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star: each larger neighbour of a node is linked to the
    smallest of node and neighbours. Small star: node and smaller neighbours are."""
    e = edges
    if both_ways:
        e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = e.join(grown(low), "u")
    if both_ways:
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node is itself a larger neighbour of its minimum
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b), the smallest node it reaches."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        e = stage(_star(_star(e, True), False), "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
