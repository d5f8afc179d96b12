"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsrisk.llm.common import stored


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, or only edges to larger ones that have no others."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"))
    )
    per_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
    return per_node.where("down > 1 OR (down = 1 AND n > 1)").limit(1).count() == 0


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node meets the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, meet the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = edges.join(least, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for each node of ``edges`` (``u``, ``v``); the root is the smallest node that it reaches.

    Neighbourhoods are only ever reduced to a minimum or joined, never gathered.
    Each round is written, so a lost executor costs part of one round; the number
    of rounds grows with the logarithm of the longest path, and edges that form
    stars already take none. Edges from a node to itself and repeated ones change
    nothing.
    """
    straight = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(straight, "edges")
    while not _stars(now):
        now = stored(_small(_large(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
