"""Samples for evaluation sets: round-robin draws over cells, and pairs of adjacent books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int) -> Column:
    """A fixed random order of keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def drawn(rows: DataFrame, cells: list[str], key: str, groups: int, size: int = 1, seed: int = 20260918) -> DataFrame:
    """`groups` groups of `size` rows, one cell after another and round after round; adds group (from 0) and place (from 1).

    A cell with too few rows left for a group is passed over; null cells are cells of their own.
    """
    by_hash = W.partitionBy(*cells).orderBy(shuffled(F.col(key), seed), key)
    placed = rows.withColumn("__n", F.row_number().over(by_hash) - 1).withColumn("__all", F.count(F.lit(1)).over(W.partitionBy(*cells)))
    whole = placed.withColumn("__round", F.floor(F.col("__n") / size)).filter((F.col("__round") + 1) * size <= F.col("__all"))
    # Only the first rounds can be reached: a round gives at least one group.
    early = whole.filter(F.col("__round") < groups)
    order = W.orderBy("__round", *[F.col(c).asc_nulls_first() for c in cells])
    numbered = early.filter(F.col("__n") % size == 0).select("__round", *cells).withColumn("group", F.row_number().over(order).cast("long") - 1).filter(F.col("group") < groups)
    chosen = numbered.select(F.col("__round").alias("__r"), F.col("group"), *[F.col(c).alias(f"__{c}") for c in cells])
    same = F.col("__round") == F.col("__r")
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = early.join(chosen, same)
    return found.select(*[F.col(c) for c in rows.columns], "group", (F.col("__n") % size + 1).cast("long").alias("place"))


def adjacent_pairs(rows: DataFrame, book: str, key: str, pairs: int, seed: int = 20260918) -> DataFrame:
    """(group, left, right): a row of each book with one of the next, books in order, each row at most once."""
    by_hash = W.partitionBy(book).orderBy(shuffled(F.col(key), seed), key)
    two = rows.filter(F.col(book).isNotNull()).withColumn("__n", F.row_number().over(by_hash)).filter("__n <= 2")
    books = two.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("__n", key)))[key].alias("keys"))
    order = W.orderBy(book)
    # A book's first row goes to the pair with the book before it; its next one to that with the book after.
    lined = books.withColumn("group", F.row_number().over(order).cast("long") - 1).withColumn("following", F.lead("keys").over(order))
    used_one = F.col("group") > 0
    left = F.when(used_one, F.get("keys", F.lit(1))).otherwise(F.get("keys", F.lit(0)))
    found = lined.select("group", left.alias("left"), F.get("following", F.lit(0)).alias("right")).filter("left is not null and right is not null")
    return found.withColumn("group", F.row_number().over(W.orderBy("group")).cast("long") - 1).filter(F.col("group") < pairs)


def question_sets(rows: DataFrame, cells: list[str], book: str, key: str, total: int, ratio: tuple[float, float, float]) -> dict[str, DataFrame]:
    """Three draws without a row in common: single rows, groups of three, pairs across books."""
    single, three, pairs = max(1, round(total * ratio[0])), max(0, round(total * ratio[1])), max(0, round(total * ratio[2]))
    one = drawn(rows, cells, key, single)
    rest = rows.join(one.select(key), key, "left_anti")
    many = drawn(rest, cells, key, three, 3)
    left = rest.join(many.select(key), key, "left_anti")
    return {"single_hop": one, "aggregation": many, "cross_book": adjacent_pairs(left, book, key, pairs)}
