"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_counted, stage


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Label each node of edges(a, b) with the smallest node it reaches: (node, root).

    a and b are long; loops, repeated edges and both directions are allowed, rows with a
    null end are ignored, an empty table gives an empty one. Every step groups by node with
    a minimum, combined before the shuffle, and joins it back, a hub's edges by broadcast of
    its one row (see join_counted), so a hub is never gathered in one place; each round is
    staged, so lost executors cost one round at most.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = stage(e, "cc")
    for _ in range(max_rounds):
        # large star: every larger neighbour is tied to the smallest one around
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stage(_with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "cc")
        # small star: the node and its smaller neighbours are tied to the smallest of them
        tied = _with_least(large).select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        small = stage(tied.distinct(), "cc")
        # done once every node has one edge and no root has one: a set of stars
        n, nodes = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
        e = small
        if not n or (n == nodes and not small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1)):
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(a, b) with m, the smallest b of each a, and n, how many it has."""
    return join_counted(edges, stage(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least"), "a")
