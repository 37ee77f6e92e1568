"""Distributed connected components by alternating large-star and small-star steps.

Every step is a group-wise minimum (with map-side combine) and a join back, so a node with very many neighbours is
never gathered: its edges stay spread, and adaptive execution splits its join partition.  Edges are written to the
shared checkpoint folder after each round.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) joins to another; ``root`` is the component's least node.

    Nulls and loops are no edges; repeated and reversed edges count once; an empty table gives an empty table.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a) != F.col(b)).alias("apart"))
    now = checkpointed(now.where("apart").select("a", "b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        now = checkpointed(_small_star(_large_star(now)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
