"""Connected components of an edge list, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself; edges lead to the smaller node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    links = edges.select(F.col("a").alias("v"), F.col("b").alias("a"))
    return links.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these; edges lead to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether nothing is both a child and a root, and no child has two roots."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"))
    )
    ways = ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("root"))
    return ways.where("up > 1 OR up = 1 AND root = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``: longs); component is the smallest node reachable.

    Large-star and small-star rounds in turn until every edge leads to a node that no edge leaves. The number of rounds
    grows with the logarithm of the longest chain. Each star is one table in the shared folder, as a star reads its edges
    several times and a plan of both would make the first again for each; hot nodes are met by a minimum (combined before the
    shuffle) and a join that Spark may split, never by gathering a node's neighbours.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    at = stored(edges.where("a != b").select(larger, smaller).distinct(), "edges")
    while True:
        at = stored(_small_star(stored(_large_star(at), "edges")), "edges")
        if _settled(at):
            break
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
