"""Quotes that a model gives for an answer, held against the passages it saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.selectors import verbatim

#: Characters of a passage that a model sees, passages of a question, quotes kept, and a quote's least and most characters.
SEEN, SOURCES, QUOTES, LEAST, MOST = 7000, 12, 3, 40, 1200
#: Lines by which a table is told, characters of a quote by which two are the same.
TABLE_LINES, SAME = 16, 400


def relevance() -> Column:
    return F.coalesce("rerank_score", "score", F.lit(0.0))


def mostly_table(text: Column) -> Column:
    """Whether half of the first lines that aren't blank, and two at least, hold two bars or more."""
    lines = F.slice(F.filter(F.split(text, r"\r\n?|\n"), lambda x: F.trim(x) != ""), 1, TABLE_LINES)
    barred = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2))
    return F.coalesce((F.size(lines) >= 2) & (barred >= F.greatest(F.lit(2), F.floor((F.size(lines) + 1) / 2))), F.lit(False))


def sources(nodes: DataFrame, limit: int = SOURCES, seen: int = SEEN) -> DataFrame:
    """nodes(query_id, node_id, document_id, text, score, rerank_score, accns) as a model sees them: the most relevant, numbered from 1, with the excerpt and an accession.

    The accession is the node's first, else the first of the most relevant node of its document
    that has one.
    """
    order = W.partitionBy("query_id").orderBy(relevance().desc(), "node_id")
    ranked = nodes.withColumn("source_index", F.row_number().over(order).cast("long")).filter(F.col("source_index") <= limit)
    own = F.when(F.size("accns") > 0, F.col("accns")[0])
    of_document = F.first(own, ignorenulls=True).over(W.partitionBy("query_id", "document_id").orderBy("source_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    accn = F.coalesce(own, F.when(F.col("document_id").isNotNull(), of_document))
    return ranked.select("query_id", "source_index", "node_id", "document_id", F.left(F.coalesce("text", F.lit("")), F.lit(seen)).alias("excerpt"), F.round(relevance(), 4).alias("relevance"), accn.alias("accn"))


def verified(quotes: DataFrame, passages: DataFrame, limit: int = QUOTES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """quotes(query_id, position, source_index, text) with what became of each: body, verdict, and `place` among the kept ones of its question.

    verdict is the first gate that a quote fails: `length`, `table`, `source` (none of that
    number), `not verbatim`, `repeated` (an earlier verbatim quote is the same but for case and
    white space), `no document`; else `kept`, or `beyond` once enough are kept. Kept quotes come
    with document_id, node_id, relevance, its level and the accession. Null texts fail by length.
    """
    text = F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    size = F.length(F.col("text"))
    met = quotes.withColumn("text", text).join(passages, ["query_id", "source_index"], "left")
    body = verbatim(F.col("text"), F.col("excerpt"))
    gate = F.when(~size.between(least, most), "length").when(mostly_table(F.col("text")), "table").when(F.col("node_id").isNull(), "source").when(body.isNull(), "not verbatim")
    gated = met.withColumns({"gate": gate, "body": F.when(gate.isNull(), body)})
    key = F.left(F.regexp_replace(F.lower("body"), r"\s+", " "), F.lit(SAME))
    again = F.row_number().over(W.partitionBy("query_id", key, F.col("gate").isNull()).orderBy("position"))
    judged = gated.withColumn("gate", F.coalesce("gate", F.when(again > 1, "repeated"), F.when(F.col("document_id").isNull(), "no document")))
    place = F.count_if(F.col("gate").isNull()).over(W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    placed = judged.withColumn("place", F.when(F.col("gate").isNull(), place))
    verdict = F.coalesce("gate", F.when(F.col("place") > limit, "beyond"), F.lit("kept"))
    kept = verdict == "kept"
    level = F.when(F.col("relevance") >= 0.55, "high").when(F.col("relevance") >= 0.35, "medium").otherwise("low")
    shown = {c: F.when(kept, F.col(c)) for c in ("body", "document_id", "node_id", "relevance", "accn", "place")}
    return placed.select("query_id", "position", verdict.alias("verdict"), *[v.alias(c) for c, v in shown.items()], F.when(kept, level).alias("level"))
