"""Connected components of links between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knownthen.sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of a link (a, b): component is the smallest node that can be reached.

    Each round hangs neighbours on the smallest neighbour and writes its links to the shared folder; rounds end when
    nothing changes, which takes a number of rounds that grows with the logarithm of the longest path. Only a count and a
    checksum reach the driver. Links of a node with itself are left out; repeated links count once.
    """
    def state(edges):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(links.filter(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least).distinct(), "small")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
