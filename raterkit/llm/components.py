"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate (the smallest neighbour of each node) and a join back, so no
neighbour list is gathered; a hot node is a skewed join that adaptive execution splits.
The edge table is written to the shared checkpoint folder after each round, which cuts the
lineage and survives lost executors; the loop ends when the edges are stars around their smallest
nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterkit.session import cut_lineage

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or smaller-or-equal (small) neighbours of each node to the
    smallest of the node and its neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a table of its own, so that the join below is one of two exchanges, which can be split
    low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
    joined = both.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node points at two others, or at one and is pointed at."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and in = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges(a, b)``.

    Edges are undirected; loops, repeats and rows with a null end are ignored. No edges: no rows.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = cut_lineage(down.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(current):
            break
        current = cut_lineage(_star(_star(current, True), False), "edges")
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component")).distinct()
