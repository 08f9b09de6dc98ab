"""Section trees and windows over ordered rows: children, siblings, neighbours, descendants, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per(rows: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("place") <= limit)


def neighbours(rows: DataFrame, seeds: DataFrame, parent: str, order: str, radius: int) -> DataFrame:
    """Rows of the seeds' parents within `radius` of a seed; seeds(parent, seed_order). An equi-join on parent and candidate order, no theta join."""
    wanted = seeds.select(parent, "seed_order", F.explode(F.sequence(F.greatest(F.col("seed_order") - radius, F.lit(0).cast("long")), F.col("seed_order") + radius)).alias(order))
    return rows.join(wanted, [parent, order])


def descendants(spark: SparkSession, edges: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """(root, node, depth) of everything below roots(root) over edges(parent, child)."""
    found = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    return spark.sql(
        f"""WITH RECURSIVE below(root, node, depth) MAX RECURSION LEVEL {max_depth} AS (
              SELECT root, node, depth FROM {{found}}
              UNION ALL
              SELECT b.root, e.child, b.depth + 1 FROM below b JOIN {{edges}} e ON e.parent = b.node)
            SELECT * FROM below WHERE depth > 0""",
        found=found,
        edges=edges,
    )


def section_tree(paths: DataFrame, by: list[str]) -> DataFrame:
    """paths(*by, path array, position) -> one row per distinct path prefix: level, first position, order and leaf count."""
    prefixes = paths.withColumn("level", F.explode(F.sequence(F.lit(1), F.size("path")))).filter("size(path) > 0").withColumn("prefix", F.expr("slice(path, 1, level)"))
    nodes = prefixes.groupBy(*by, "prefix", "level").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("leaves"))
    order = W.partitionBy(*by).orderBy("first_position", "level")
    return nodes.withColumn("order_index", (F.row_number().over(order) - 1).cast("long"))


def within_budget(rows: DataFrame, by: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group up to the first that would pass the budget; the first row always stays."""
    w = W.partitionBy(*by).orderBy(order)
    used = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("n", F.row_number().over(w)).filter((F.col("used") <= budget) | (F.col("n") == 1)).drop("n")


def nearest(value: Column, by: list[str], order: str) -> tuple[Column, Column]:
    """The last non-null value before a row and the first after it."""
    w = W.partitionBy(*by).orderBy(order)
    return F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first(value, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))


def recency_bonus(by: list[str], newest_first: list[Column], most: float = 0.18) -> Column:
    """`most` for the newest row down to 0 for the oldest, in equal steps; rows of one date differ by the later columns."""
    w = W.partitionBy(*by)
    place, steps = F.row_number().over(w.orderBy(*newest_first)) - 1, F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1)
    return F.lit(most) * (1 - place / steps)
