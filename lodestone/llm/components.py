"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def components(edges: DataFrame, files: list[str] | None = None) -> DataFrame:
    """edges: (u long, v long), any order, repeats allowed. Gives (node, component): the smallest node that is
    reachable, for every node that stands in an edge between two different nodes.

    Each round is written to the shared folder (files gets the folders' names), so a lost executor costs one round at
    most. A hub's neighbours are joined, never gathered: adaptive execution splits its partition. The end is
    reached when every node has either larger neighbours alone or one neighbour, a smaller one: stars around
    their smallest node.
    """
    current = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), files)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        if ends.where("m < u and most <> m").isEmpty():
            break
        least = ends.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(spread.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), files)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cut(current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), files)
