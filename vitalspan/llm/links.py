"""Connected components of an edge table, kept in Spark from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) is linked to.

    Alternates two star contractions. Each hands every neighbour of a node to the smallest
    node around it; minima are combined before the shuffle, and a node with very many
    neighbours is only ever one side of a join that AQE may split. Ends when the set of
    edges stays the same, after a number of rounds that grows with the logarithm of the
    longest chain. NULL ends and loops are left out; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges)
    seen = None
    while True:
        # Larger neighbours of a node go to the least node of its neighbourhood.
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # A node and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut_lineage(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    # Now each node points to its component's least node, or to nothing if it is that node.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
