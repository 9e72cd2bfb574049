"""Connected components of a graph of links, by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v). Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of comparable nodes, any direction, repeats and loops allowed.

    Returns (node, root) for every node that has a link to another; root is the component's smallest node. The number of
    rounds grows as the logarithm of the longest chain; every round is checkpointed.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # done once every node has a single link, to a node that has none
        ends = now.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("top")))))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or (up = 1 and top = 1)").isEmpty():
            break
        now = cut(_small_star(_large_star(now)))
        release(now)
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)
