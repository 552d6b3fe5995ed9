"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshare.session import staged


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``(a, b)``: root is the smallest node reachable.

    A round hangs larger neighbours, then smaller ones, on the least neighbour of each node: one combinable
    minimum and one join on the node each, so a node with very many links is a partly aggregated key and a join side
    that Spark can split.  Links stay in tables in the shared folder; only their number and checksum reach the driver.
    Rounds end when nothing changes: stars shorten paths by half at least, so they grow with the logarithm of the longest.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = _stored(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v"), "m")
        stars = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges, now = _stored(stars)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    kept = staged(edges, "links")
    return kept, tuple(kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
