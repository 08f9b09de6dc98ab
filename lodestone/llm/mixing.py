"""Mixing sources to target weights along a curriculum. DataFrame operations only.

Each source has a weight schedule over training time t in [0, 1], integrated to its cumulative
demand of words. Its documents are lined up in an order by hash, one pass after another up to
MAX_EPOCHS; the document that begins at cumulative word c is trained at the time at which the
source's demand reaches c, which inverts the integral. Copies beyond the source's target are
not taken. Sorting by that time gives the training order.

Cumulative words are two-level sums: running sums inside hash ranges of bounded size, and over
the ranges' totals, so one source with a third of all rows is spread over as many tasks as it
has ranges. Sources are ranked and their targets levelled by windows over one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged, without_repeats

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Rows of a source that are summed in one range; a source has as many ranges as its own rows ask for.
RANGE_ROWS = 1 << 9


def words_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> weight, tilt and target of each source.

    All targets share the words of all sources by weight; one that would pass MAX_EPOCHS times
    its source's size stops there and the excess is reshared. With the sources in order of
    size / weight those that stop come first: the level at a source is what the stopped ones
    before it leave, over the weights from it on.
    """
    ranked = sources.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("k") % len(WEIGHTS) + 1).cast("int"))
    tilt = F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (F.col("k") % 3 + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("tilt", tilt).withColumn("most", MAX_EPOCHS * F.col("source_size"))
    by = W.orderBy((F.col("most") / F.col("weight")), "k")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("weight").over(after))
    stopped = F.col("most") <= F.col("level") * F.col("weight")
    final = F.min(F.when(~stopped, F.struct((F.col("most") / F.col("weight")).alias("r"), "k", "level"))).over(W.partitionBy())["level"]
    return level.withColumn("final", final).select(
        "source", "source_size", "weight", "tilt", F.when(stopped, F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def time_of(share: Column, tilt: Column) -> Column:
    """The t at which a weight schedule 1 + tilt (2t - 1) has given this share of its integral.

    The integral is t + tilt (t^2 - t); the root is written so that it also holds at tilt 0.
    """
    linear = 1 - tilt
    return 2 * share / (linear + F.sqrt(linear * linear + 4 * tilt * share))


def placed(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size -> those with source_size, target, taken and `begins`, the words of the source before the row.

    The order is by md5 of doc_id (null ones last), then doc_id and size.
    """
    rank = F.md5(F.col("doc_id").cast("string"))
    sources = Staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    bits = F.least(F.lit(32), F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / RANGE_ROWS)))).cast("int")
    cuts = Staged(sources.df.select(F.col("source").alias("of"), bits.alias("bits"))).for_join(200)
    leading = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long")
    cut = F.call_function("shiftrightunsigned", leading, 32 - F.col("bits"))
    ranked = sizes.withColumn("rank", rank).join(cuts, F.col("source").eqNullSafe(F.col("of")))
    lined = ranked.withColumn("range", F.coalesce(cut, F.lit(1 << 32).cast("long"))).drop("of", "bits")
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = lined.groupBy("source", "range").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    goals = targets(sources.df.select("source", "source_size"))
    ranges = Staged(ranges.join(goals, ranges["source"].eqNullSafe(goals["source"])).select(ranges["source"].alias("of"), ranges["range"].alias("in"), "offset", "source_size", "target", "weight", "tilt"))
    sources.drop()
    own = ranges.for_join(80)
    inside = W.partitionBy("source", "range").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    within = lined.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = within.join(own, within["source"].eqNullSafe(own["of"]) & (within["range"] == own["in"]))
    begins = F.col("offset") + F.col("inside")
    passes = [F.when(2 * (F.lit(e) * F.col("source_size") + begins) + F.col("size") < 2 * F.col("target"), 1).otherwise(0) for e in range(MAX_EPOCHS)]
    return found.withColumn("begins", begins).withColumn("copies", sum(passes, F.lit(0))).drop("of", "in", "offset", "inside", "rank", "range", "weight")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and position (time of the first copy, null if none is taken) of every row of docs.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, last in
    the order. A source without words has target 0. Repeated rows are separate documents that
    follow one another. Other columns are ignored, an empty table gives an empty result.
    """
    sizes = Staged(docs.select("doc_id", "source", words_of(F.col("text")).alias("size")))
    rows = placed(sizes.df)
    first = F.when((F.col("copies") > 0) & (F.col("target") > 0), time_of(F.least(F.lit(1.0), F.col("begins") / F.col("target")), F.col("tilt")))
    return rows.select("doc_id", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"), first.alias("position"))


def in_training_order(rows: DataFrame) -> DataFrame:
    """What mix() returns, range-sorted by position; rows that are not taken come last."""
    by = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return Staged(rows).df.repartitionByRange(*by).sortWithinPartitions(*by, "size")


def curriculum(docs: DataFrame) -> DataFrame:
    """The documents in training order: a row for each taken copy, range-sorted by its time, with the columns of docs.

    Documents without words are in no source's demand; they come once each, at time 0, so that
    a mix drops nothing it did not weigh. A document is known by its doc_id (null ones included)
    and text; rows that repeat both count once.
    """
    known = without_repeats(docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit("")))), ["doc_id", "__hash"])
    sizes = Staged(known.select("doc_id", "source", "__hash", words_of(F.col("text")).alias("size")))
    rows = placed(sizes.df).filter("copies > 0 or size = 0")
    epochs = rows.select("doc_id", "__hash", "begins", "source_size", "target", "tilt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1)).alias("epoch"))
    words = F.col("epoch") * F.col("source_size") + F.col("begins")
    time = F.when(F.col("target") > 0, time_of(F.least(F.lit(1.0), words / F.col("target")), F.col("tilt"))).otherwise(F.lit(0.0))
    timed = epochs.select(F.col("doc_id").alias("__taken_id"), F.col("__hash").alias("__taken_hash"), time.alias("__taken_at"))
    joined = known.join(timed, F.col("doc_id").eqNullSafe(F.col("__taken_id")) & (F.col("__hash") == F.col("__taken_hash")))
    return joined.repartitionByRange("__taken_at", "__taken_id").sortWithinPartitions("__taken_at", "__taken_id", "__taken_hash").select(docs.columns)
