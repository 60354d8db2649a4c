"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least node around it: the larger ones, or the smaller ones and itself."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")  # a hot node's edges are split by the adaptive skew join
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """The nodes that keep distinct edges (u, v), v < u, from being stars around least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the long columns u and v.

    Each step is written to the shared folder; the rounds grow with the logarithm of the longest
    path. They end when each node but the least ones has one edge, and that to a least one: a look at
    the nodes' degrees, summed within each task first, not a further round that changes nothing.
    Loops and repeated edges are allowed; no edges give an empty result.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while True:
        step = materialize(_star(_star(now, True), False), "edges")
        discard(now)
        now = step
        if not _unsettled(now).head(1):
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
