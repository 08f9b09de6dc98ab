"""Evaluation of retrieval: rank metrics, latency percentiles, panels and the regression gate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """hits(query_id, node_id, rank), gold(query_id, node_id) -> hit, gold_recall and mrr of each query with gold."""
    judged = hits.filter(F.col("rank") <= k).join(gold.withColumn("gold", F.lit(True)), ["query_id", "node_id"], "left")
    found = judged.groupBy("query_id").agg(F.count_distinct(F.when(F.col("gold"), F.col("node_id"))).alias("n_found"), F.min(F.when(F.col("gold"), F.col("rank"))).alias("first_rank"))
    sizes = gold.groupBy("query_id").agg(F.count_distinct("node_id").alias("n_gold"))
    joined = sizes.join(found, "query_id", "left")
    return joined.select(
        "query_id",
        F.coalesce((F.col("n_found") > 0).cast("int"), F.lit(0)).alias("hit"),
        F.round(F.coalesce("n_found", F.lit(0)) / F.col("n_gold"), 6).alias("gold_recall"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"),
    )


def floor_place(n: Column, share: float) -> Column:
    """floor(share * (n - 1)), from 0."""
    return F.floor(F.lit(share) * (n - 1)).cast("long")


def bankers_place(n: Column, percent: float) -> Column:
    """percent / 100 * (n - 1), rounded half to even."""
    return F.bround(F.lit(percent / 100) * (n - 1), 0).cast("long")


def elements_at(rows: DataFrame, by: list[str], value: str, places: dict[str, Column], bins: int = 4096) -> DataFrame:
    """One row a group: the elements of its sorted non-null values at `places`, functions of the column n from 0.

    Values are counted in `bins` equal stretches of a group's range; only those of the stretch that holds a
    place are then counted one by one, so no task sorts a whole group and equal values are one row. Groups of
    nulls alone have no row. NaN and infinities have stretches of their own at the ends.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    held = rows.filter(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    ends = held.groupBy(F.col("g").alias("eg")).agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.count(F.lit(1)).alias("n"))
    inner = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0)) * bins))
    spot = F.when(F.isnan("v"), bins + 1).when(F.col("v") == float("inf"), bins).when(F.col("v") == float("-inf"), -1).otherwise(F.coalesce(inner, F.lit(0)))
    binned = held.join(ends, F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", spot.cast("int").alias("spot"), "n")
    sums = binned.groupBy("g", "spot", "n").agg(F.count(F.lit(1)).alias("size")).withColumn("end", F.sum("size").over(W.partitionBy("g").orderBy("spot")))
    asked = sums.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.alias("at")) for name, at in places.items()])).alias("x")).select("*", "x.*")
    asked = asked.filter((F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("size")))
    asked = asked.select(F.col("g").alias("ag"), F.col("spot").alias("aspot"), "name", (F.col("at") - F.col("end") + F.col("size")).alias("at"))
    there = F.col("g").eqNullSafe(F.col("ag")) & (F.col("spot") == F.col("aspot"))
    near = binned.select("g", "v", "spot").join(asked, there, "left_semi").groupBy("g", "spot", "v").agg(F.count(F.lit(1)).alias("size"))
    near = near.withColumn("upto", F.sum("size").over(W.partitionBy("g", "spot").orderBy("v")))
    found = near.join(asked, there & (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("size")))
    return found.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places]).select(*[F.col(f"g.{c}") for c in by], *places)


def gate(current: DataFrame, baseline: DataFrame, threshold: float) -> DataFrame:
    """(metric, higher_better, value) twice -> relative change and whether it is a regression."""
    base = baseline.select("metric", F.col("value").alias("baseline"))
    change = (F.col("value") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0))
    worse = F.when(F.col("higher_better"), F.col("change") < -threshold).otherwise(F.col("change") > threshold)
    joined = current.join(base, "metric", "left").withColumn("change", F.round(change, 6))
    return joined.withColumn("regression", F.coalesce(worse, F.lit(False)))


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Sizes of the intersection and the union of two arrays and their Jaccard share, 4 digits."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return {"n_both": both.cast("long"), "n_either": either.cast("long"), "jaccard": F.round(F.when(either > 0, both / either).otherwise(0.0), 4)}


def first_mode(rows: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_at"))
    return counted.groupBy(*by).agg(F.max(F.struct("n", -F.col("first_at"), F.col(value).alias("mode"))).alias("m")).select(*by, "m.mode", F.col("m.n").alias("n"))


#: White space that windows leave out.
_WHITE = dict.fromkeys([*range(0x09, 0x0E), 0x20])
#: Windows of questions up to which they are broadcast (about 16 MB).
BROADCAST_WINDOWS = 100_000


def char_windows(rows: DataFrame, key: str, text: str, n: int, block: int = 512) -> DataFrame:
    """key, w: every run of n characters of a text, white space left out; shorter texts have none.

    Texts are first cut into overlapping blocks, since finding a character by its number takes
    time in proportion to that number.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", "")
    upto = lambda c, step: F.when(F.length(c) >= n, F.sequence(F.lit(0), ((F.length(c) - n) / step).cast("int")))
    cut = lambda c, at, size: F.substring(F.col(c), at + 1, F.lit(size))
    placed = rows.select(key, bare.alias("bare")).select(key, "bare", F.explode(upto("bare", block)).alias("i"))
    blocks = placed.select(key, cut("bare", F.col("i") * block, block + n - 1).alias("part"))
    return blocks.select(key, "part", F.explode(upto("part", 1)).alias("j")).select(key, cut("part", F.col("j"), n).alias("w"))


def copied_runs(questions: DataFrame, texts: DataFrame, n: int = 16) -> DataFrame:
    """(question_id, text_id, shared): how many different runs of n characters a question(question_id, text) has in common with a text(text_id, text).

    The windows of texts are met where they are read: those of the questions are held by every
    task as long as few enough are counted, and joined by key beyond that.
    """
    asked = char_windows(questions, "question_id", "text", n).distinct()
    few = asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    if few:
        held = asked.select("w").distinct()
        found = held_windows(texts, "text_id", "text", n, frozenset(r["w"] for r in held.toLocalIterator())).join(F.broadcast(asked), "w")
    else:
        found = char_windows(texts, "text_id", "text", n).join(asked, "w")
    return found.groupBy("question_id", "text_id").agg(F.count_distinct("w").alias("shared"))


def held_windows(rows: DataFrame, key: str, text: str, n: int, windows: frozenset[str]) -> DataFrame:
    """(key, w): the windows of char_windows that are among the given ones, each once a row.

    A text is looked at every n // 2 characters, as each window holds a stretch of so many that
    begins there; only around stretches that some given window holds are windows cut out.
    """
    half = max(1, n // 2)
    parts = frozenset(w[i : i + half] for w in windows for i in range(n - half + 1))
    sent = rows.sparkSession.sparkContext.broadcast((windows, parts))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        whole, some = sent.value
        for batch in batches:
            places, found = [], []
            for i, raw in enumerate(batch.column("text").to_pylist()):
                bare = (raw or "").translate(_WHITE)
                hits = set()
                for at in range(0, len(bare) - half + 1, half):
                    if bare[at : at + half] in some:
                        hits.update(w for j in range(max(0, at + half - n), at + 1) if (w := bare[j : j + n]) in whole)
                places += [i] * len(hits)
                found += hits
            yield pa.record_batch([batch.column("key").take(pa.array(places, pa.int64())), pa.array(found, pa.string())], names=[key, "w"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, w string")


def soft_scores(rows: DataFrame) -> DataFrame:
    """rows(metric, score) -> scored, skipped and the mean of each metric, 4 digits; null and NaN scores are skipped."""
    good = F.col("score").isNotNull() & ~F.isnan("score")
    return rows.groupBy("metric").agg(F.count_if(good).alias("scored"), F.count_if(~good).alias("skipped"), F.round(F.avg(F.when(good, F.col("score"))), 4).alias("mean"))
