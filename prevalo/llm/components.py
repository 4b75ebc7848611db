"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another: root is the component's smallest node.

    links: (u long, v long). Large-star and small-star steps by turns: each connects nodes to the smallest
    neighbour they know, so the depth of the trees falls by half or more each time. The links of
    one round are written before the next, and rounds end when nothing changes. Minima are
    partial sums; the joins' one side has each node once, so Spark can split the other where a node is hot.
    """
    pairs = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = stage(pairs, "links")
    before = _mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stage(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = _mark(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(pairs: DataFrame) -> tuple:
    """Number and check sum of the links: equal marks, equal links."""
    digest = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(digest), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
