"""Connected components by alternating large-star and small-star steps; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbours(both).select(F.col("a"), F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least_neighbours(down)
    joined = down.join(least, "a")
    moved = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): links between longs, any direction, repeats and loops allowed -> (node, root), root the least node reached.

    Nodes without a link to another node don't appear.
    """
    current = Staged(edges.filter("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        state = current.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return current.df.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).unionByName(
                current.df.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
            )
        seen = (state["n"], state["h"])
        after = Staged(_small_star(_large_star(current.df).filter("a <> b").distinct()).filter("a <> b").distinct())
        current.drop()
        current = after
