"""Structured observations: filters, staged fallback, ranking, distributions by filing, periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def observations(rows: DataFrame, equal: dict[str, object] | None = None, among: dict[str, list] | None = None, years: list[int] | None = None, period: str = "period_end") -> DataFrame:
    """rows that meet every given condition; missing and empty ones don't filter, years before 1900 are dropped."""
    parts = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    parts += [F.col(c).isin(list(v)) for c, v in (among or {}).items() if v]
    wanted = [y for y in years or [] if y >= 1900]
    if wanted:
        parts.append(F.year(period).isin(wanted))
    return rows.filter(reduce(Column.__and__, parts)) if parts else rows


def newest(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The first `limit` rows by descending columns, nulls last."""
    return rows.orderBy(*[F.col(c).desc_nulls_last() for c in columns]).limit(limit)


def matches_hints(key: Column, label: Column, hints: list[str]) -> Column:
    """Any hint of 6 word characters or more, at most 12 of them, is part of key or label, case ignored."""
    bare = [h for h in ("".join(c for c in hint if c.isalnum() or c == "_") for hint in hints) if len(h) >= 6][:12]
    parts = [F.lower(c).contains(h.lower()) for h in bare for c in (key, label)]
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def staged(stages: list[DataFrame], key: list[str], enough: int, order: list) -> DataFrame:
    """Rows of the first stages until `enough` are there: a stage counts only if those before it gave fewer."""
    tagged = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    union = reduce(DataFrame.unionByName, tagged)
    once = union.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("stage"))).filter("n = 1").drop("n")
    sizes = once.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("stage").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    used = before.filter(F.col("before") < enough).select("stage")
    return once.join(F.broadcast(used), "stage").orderBy("stage", *order).limit(enough)


def filing_weights(hits: DataFrame, filing: str, signal: Column, least: float = 0.25) -> DataFrame:
    """Weight (sum of the signal, at least `least` each) and count of each filing."""
    return hits.groupBy(filing).agg(F.round(F.sum(F.greatest(F.lit(least), signal)), 4).alias("weight"), F.count(F.lit(1)).alias("n"))


def accession_periods(rows: DataFrame) -> DataFrame:
    """rows(accn, pos, fy, fp, end, concept, value) -> fiscal year, period and end of each filing, with where they come from.

    The filing's own statements (concepts of document information; the last one counts) precede
    the most frequent values among its facts, ties to the one seen first; the most frequent end
    is taken among rows of the modal year and period.
    """
    own = lambda concept: F.max(F.when((F.col("concept") == concept) & F.col("value").isNotNull(), F.struct("pos", "value")))["value"]
    stated = rows.groupBy("accn").agg(own("DocumentFiscalYearFocus").alias("dei_fy"), own("DocumentFiscalPeriodFocus").alias("dei_fp"), own("DocumentPeriodEndDate").alias("dei_end"))

    def mode(of: DataFrame, column: str) -> DataFrame:
        counted = of.filter(F.col(column).isNotNull()).groupBy("accn", column).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
        return counted.groupBy("accn").agg(F.max(F.struct("n", -F.col("p"), F.col(column).alias("v")))["v"].alias(f"mode_{column}"))

    years, periods = mode(rows, "fy"), mode(rows, "fp")
    modal = rows.join(years, "accn", "left").join(periods, "accn", "left").filter(F.col("fy").eqNullSafe(F.col("mode_fy")) & F.col("fp").eqNullSafe(F.col("mode_fp")))
    joined = stated.join(years, "accn", "left").join(periods, "accn", "left").join(mode(modal, "end"), "accn", "left")
    return joined.select(
        "accn",
        F.coalesce(F.col("dei_fy").try_cast("int"), F.col("mode_fy").cast("int")).alias("fy"),
        F.coalesce(F.upper(F.trim("dei_fp")), "mode_fp").alias("fp"),
        F.coalesce(F.left("dei_end", F.lit(10)), "mode_end").alias("period_end"),
        F.when(F.col("dei_fy").isNotNull(), "dei").when(F.col("mode_fy").isNotNull(), "mode").alias("source"),
    )
