"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that occurs in ``links`` (a, b: long), where root is the smallest node reachable.

    Alternates large-star and small-star steps: each node's larger neighbours, then its smaller ones, are
    linked to its smallest neighbour. A step joins the links with one row a node: a hub's links are sorted in one
    task, but streamed as rows of two longs and never collected, and the number of links never grows. The rounds
    grow with the logarithm of the longest path; each is cut from its lineage by a checkpoint. Self links and repeated links are allowed;
    nodes that only link to themselves, and an empty table, give no row.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.*").where("a <> b").distinct())
        roots = edges.select(F.col("b").alias("a")).distinct()
        if edges.join(roots, "a", "left_semi").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
