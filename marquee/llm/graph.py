"""Connected components of a list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node that links reach.

    Every node is tied to the smallest neighbour of its neighbours until nothing changes;
    the number of rounds grows with the logarithm of the longest chain. Each round is two
    minima per node (combined before the shuffle) and a written table of links.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges_2 = cut_lineage(large.where("a <> b").distinct(), label)
        # small star: smaller neighbours and the node itself move there
        low = edges_2.groupBy("a").agg(F.min("b").alias("m"))
        small = edges_2.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = cut_lineage(small.where("a <> b").distinct(), label)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = new
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
