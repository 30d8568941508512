"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import discard, stored


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Points the larger (large) or smaller neighbours of each node at the smallest node near it, stored."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # stored, so that both sides of the join have their own shuffle and a hub's edges can be split
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * most)
    joined = near.join(least.hint("merge"), "u")
    if large:  # repeated edges wait for the small stars
        out = stored(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), 2 * most)
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        out = stored(out.filter("u <> v").distinct(), 2 * most)
    discard(least, edges)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a root or points at one root alone."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    flags = ends.groupBy("node").agg(F.min("out").alias("low"), F.sum("out").alias("outs"))
    return flags.filter("outs > 1 OR (outs = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node of its component.

    edges: u, v, of one orderable type. Nulls and loops are ignored, so a node that has
    only those is absent; repeated edges count once. Every round is written to the shared
    folder and the one before deleted; rounds grow with the logarithm of the longest path.
    `most` is an upper bound of the number of edges, where it is known.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), most)
    most = edges.count()  # stars do not add edges
    while not _settled(edges):
        edges = _stars(_stars(edges, True, most), False, most)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
