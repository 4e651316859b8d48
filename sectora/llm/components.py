"""Connected components of a table of links, by alternating large and small stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def roots(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, root for every linked node that isn't its component's smallest node.

    Each round hangs nodes on the smallest neighbour they see; rounds grow with the logarithm of the longest path. A node with very many links is
    spread by the join's skew handling, and minima are taken before the shuffle. Null ends and links from a node to itself are left out.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        edges = stored(edges, "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(seen)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        edges = small.select("u", F.col("low").alias("v")).union(small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct()
