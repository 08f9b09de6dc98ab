"""Facts as nodes for text search: lines in batches, each with what it can be filtered by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.search import BROADCAST_BYTES
from lodestone.session import stored

LINES = 64
#: About what a key and its number hold.
ROW_BYTES = 32
#: The lists that a node can be filtered by, their columns and the most values of each.
LISTS = (("metric_keys", "metric_key", 24), ("forms", "form", 8), ("accns", "accn", 24), ("period_years", None, 12), ("period_end_dates", "period_end", 24))
#: What a fact's line is made of.
FACT = ("taxonomy", "metric_key", "metric_label", "unit", "value_numeric", "value_text", "period_end", "filed_date", "form", "fy", "fp", "accn")


def few(numbers: DataFrame) -> DataFrame:
    """Rows of a key and numbers, with a broadcast hint if they fit search.BROADCAST_BYTES, so that what they are joined with stays where it is."""
    return F.broadcast(numbers) if numbers.count() * ROW_BYTES <= BROADCAST_BYTES else numbers


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `position` from 0 within each key, also where one key has a third of all rows.

    Rows are sorted by range and stored once with their places; the places at which keys start in
    a range give the positions, so rows move once. Number only the columns that the rest is made of.
    """
    place = F.monotonically_increasing_id()
    cut = stored(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__place", place))
    part = F.shiftright("__place", 33)
    counts = cut.groupBy(F.col(key).alias("__key"), part.alias("__in")).agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("__key").orderBy("__in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = stored(counts.select("__key", "__in", (before - F.col("first")).alias("__shift")))
    joined = cut.join(few(starts), F.col(key).eqNullSafe(F.col("__key")) & (part == F.col("__in")))
    return joined.withColumn("position", F.col("__place") + F.col("__shift")).drop("__place", "__key", "__in", "__shift")


def line(fact: Column) -> Column:
    """A fact in one line; what is missing is None, a missing value blank."""
    text = lambda c: F.coalesce(fact[c].cast("string"), F.lit("None"))
    label = F.left(F.replace(F.coalesce(fact["metric_label"], F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(200))
    value = F.coalesce(fact["value_numeric"].cast("string"), fact["value_text"], F.lit(""))
    return F.concat(text("taxonomy"), F.lit("."), text("metric_key"), F.lit(" | "), label, F.lit(" | unit="), text("unit"), F.lit(" | val="), value, F.lit(" | end="), text("period_end"), F.lit(" | filed="), text("filed_date"), F.lit(" | form="), text("form"), F.lit(" | fy="), text("fy"), F.lit(" fp="), text("fp"), F.lit(" | accn="), text("accn"))


def batches(facts: DataFrame, lines: int = LINES) -> DataFrame:
    """A row for each `lines` facts of a document: document_id, order_index, n_lines, text and LISTS, each list's values in order, once, blank ones left out.

    facts have a position from 0 within the document (see numbered), taxonomy, metric_key,
    metric_label, unit, value_numeric, value_text, period_end, filed_date, form, fy, fp, accn.
    A group holds at most `lines` rows, however many a document has.
    """
    row = F.struct(F.col("position").alias("p"), *[F.col(c) for c in FACT])
    cut = facts.select("document_id", F.floor(F.col("position") / lines).alias("order_index"), row.alias("r"))
    # Dealt out first, as lists that are begun before the shuffle save nothing.
    held = cut.repartition("document_id", "order_index").groupBy("document_id", "order_index").agg(F.sort_array(F.collect_list("r")).alias("rows"))

    def value(column: str | None) -> Callable[[Column], Column]:
        if column is not None:
            return lambda r: F.nullif(F.trim(r[column].cast("string")), F.lit(""))
        year = lambda r: F.left(r["period_end"].cast("string"), F.lit(4))
        return lambda r: F.when(year(r).rlike("^[0-9]{4}$"), year(r))

    lists = [F.slice(F.array_distinct(F.array_compact(F.transform("rows", value(column)))), 1, most).alias(name) for name, column, most in LISTS]
    return held.select("document_id", "order_index", F.size("rows").cast("long").alias("n_lines"), F.array_join(F.transform("rows", line), "\n").alias("text"), *lists)


def nodes(facts: DataFrame, documents: DataFrame, lines: int = LINES) -> DataFrame:
    """documents(document_id, cik, entity_name) and their facts as nodes: a summary of level 2 and a chunk of level 0 below it for each batch.

    node_id, document_id, parent_id, level, order_index, title, text and LISTS. A document
    without facts has one chunk that says so.
    """
    found = batches(facts, lines)
    sums = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_facts")).withColumn("n_chunks", F.floor((F.col("n_facts") - 1) / lines) + 1)
    full = documents.select("document_id", "cik", F.coalesce("entity_name", F.lit("")).alias("entity_name")).join(sums, "document_id", "left").na.fill(0, ["n_facts", "n_chunks"])
    root = F.concat(F.lit("f"), F.col("document_id").cast("string"))
    none = [F.array().cast("array<string>").alias(name) for name, _, _ in LISTS]
    summary = F.concat(F.lit("SEC EDGAR company facts (XBRL): "), F.col("entity_name"), F.lit(" | CIK "), F.coalesce(F.col("cik").cast("string"), F.lit("None")), F.lit(" | "), F.col("n_facts").cast("string"), F.lit(" observations. Use SQL/API for precise metric filters; chunks below are for semantic retrieval."))
    own = full.select(root.alias("node_id"), "document_id", F.lit(None).cast("string").alias("parent_id"), F.lit(2).cast("long").alias("level"), F.lit(0).cast("long").alias("order_index"), F.lit("Document Summary").alias("title"), summary.alias("text"), *none)
    title = lambda i, n: F.concat(F.lit("SEC facts "), (i + 1).cast("string"), F.lit("/"), n.cast("string"))
    chunk = lambda rows, i, n, text, lists: rows.select(F.concat(root, F.lit("."), i.cast("string")).alias("node_id"), "document_id", root.alias("parent_id"), F.lit(0).cast("long").alias("level"), i.cast("long").alias("order_index"), title(i, n).alias("title"), text.alias("text"), *lists)
    chunks = chunk(found.join(few(full.select("document_id", "n_chunks")), "document_id"), F.col("order_index"), F.col("n_chunks"), F.col("text"), [name for name, _, _ in LISTS])
    empty = chunk(full.filter("n_chunks = 0"), F.lit(0), F.lit(1), F.lit("(no observations in facts payload)"), none)
    return own.unionByName(chunks).unionByName(empty)
