"""Connected components by alternating large and small stars, one Spark join per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table
from ledgerlight.operators.lookup import spread_join

#: Edges of one node that a task should get at most.
HUB = 256


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n_rows"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("m", F.least("a", "m"))
    return spread_join(both.where("b > a"), least, ["a"], hot_rows=HUB).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, move to the smallest of them."""
    least = _least(edges)
    moved = spread_join(edges, least, ["a"], hot_rows=HUB).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long) that isn't itself the root, its component's smallest node.

    Loops are ignored; repeated and reversed edges count once; an empty table gives an empty one.
    Labels come from grouped minima, combined before they are shuffled, and from joins that deal a hub's
    edges to as many tasks as they need. Each step is written to the shared folder, so lineage stays short.
    """
    current = scratch_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        current = scratch_table(_small_star(scratch_table(_large_star(current), "large-star")), "small-star")
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
