"""Connected components of a table of links, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import join_one, materialise, release


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the least node that each node of links reaches.

    Rounds of two steps on the links, until nothing changes: each node's larger
    neighbours are tied to its least neighbour, then each node's smaller neighbours and
    itself are. A path of n nodes takes O(log n) rounds, and no round has more links than the
    input has. Both steps are a grouped minimum, combined before the shuffle, and a join on the node that
    deals a hub's links to several tasks (`join_one`).
    Null ends and links of a node with itself tie nothing. Repeated links count once.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = materialise(least, "least")
        # larger neighbours, and the node itself, to the least
        large = join_one(both.where("v > u"), least.select("u", "m"), "u", counts=least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = materialise(large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct(), "large")
        release(edges, least)
        # smaller neighbours, and the node itself, to the least of them
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_one(large, least.select("u", "m"), "u", counts=least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        # done when every node has one link, to a node that has none upwards: a star for each component
        parts = small.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = small.select(F.col("v").alias("u")).distinct()
        open_ = parts.join(roots, "u", "left_semi").unionByName(parts.where("n > 1")).limit(1).count()
        release(large, least)
        edges = small
        if not open_:
            nodes = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
