"""Connected components by alternating large-star and small-star steps.

R. Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Neighbour
lists are never gathered: a step is an aggregation of the smallest neighbour and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget
from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger to the smaller end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    ).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is the larger end of one edge at most, and then of no other the smaller."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("larger"), F.lit(1).alias("smaller"))
    )
    nodes = ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return not nodes.agg(F.count_if((F.col("larger") > 0) & (F.col("larger") + F.col("smaller") > 1))).first()[0]


def joined(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """Edges (``a``, ``b``) with the same components as ``edges``, from larger to smaller
    nodes. After all steps each node but the smallest has one, which leads there; fewer
    ``steps`` may end before. Stored."""
    edges = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    stored, taken = None, 0
    while True:
        before, stored = stored, materialize(_small_star(_large_star(edges)), "stars")
        if before is not None:
            forget(before)
        edges, taken = stored, taken + 1
        if taken == steps or _stars(edges):
            return edges


def labels_of(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` from edges of ``joined``. Nodes of one label are connected; after
    all steps, those of a component have one label."""
    return edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for all nodes of ``edges``
    (``a``, ``b``) but those that are the smallest themselves. Stored."""
    return joined(edges).select(F.col("a").alias("node"), F.col("b").alias("label"))
