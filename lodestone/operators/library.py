"""Listings of a document library: what is shown, in which order, under which name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shapes of a filing's title line and file name.
TITLE_LINE = r"^EDGAR\s+(\S+)\s*\|\s*([0-9]{10}-[0-9]{2}-[0-9]{6})"
FILE_NAME = r"EDGAR_([0-9]+)_([0-9]{10}-[0-9]{2}-[0-9]{6})"


def nodes_of(nodes: DataFrame, document_id: int) -> DataFrame:
    """All nodes of a document, the highest level first, then by order_index."""
    return nodes.filter(F.col("document_id") == document_id).orderBy(F.col("level").desc(), "order_index", "node_id")


def inventory(documents: DataFrame, source: str, statuses: tuple[str, ...] = ("completed", "ingesting", "failed")) -> DataFrame:
    """documents(document_id, metadata map) of a source that have one of the statuses, with status, book_id, chapter_index (a whole number or null) and `place`: by book, chapter (null ones last) and id."""
    of = F.col("metadata")
    chapter = F.when(of["chapter_index"].rlike("^[0-9]{1,9}$"), of["chapter_index"]).try_cast("int")
    held = documents.filter((of["source"] == source) & of["status"].isin(*statuses)).withColumns({"status": of["status"], "book_id": of["book_id"], "chapter_index": chapter})
    order = [F.col("book_id").asc_nulls_last(), F.col("chapter_index").asc_nulls_last(), F.col("document_id")]
    return held.withColumn("place", F.row_number().over(W.partitionBy("book_id").orderBy(*order)).cast("long"))


def points(rows: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    """The rows of ids(key, place), each id once, with the least place it is asked at; ids that aren't there give nothing."""
    return rows.join(ids.groupBy(key).agg(F.min("place").alias("place")), key)


def documents_of_hits(hits: DataFrame, limit: int, chunks: int = 3) -> DataFrame:
    """hits(query_id, document_id, node_id, score, title, text, order_index) by document: the `limit` documents of the best score.

    query_id, document_id, title of the best hit (or one made of the id), score (1 at most),
    top_chunks (the best with number, 200 characters, score and node_id), place and n_documents,
    how many documents the question found.
    """
    order = W.partitionBy("query_id", "document_id").orderBy(F.col("score").desc_nulls_last(), "node_id")
    best = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= chunks)
    chunk = F.struct("n", (F.coalesce("order_index", F.lit(0)) + 1).alias("section_number"), F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("text_preview"), F.coalesce("score", F.lit(0.0)).alias("score"), "node_id")
    grouped = best.groupBy("query_id", "document_id").agg(F.max(F.when(F.col("n") == 1, F.col("title"))).alias("title"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.sort_array(F.collect_list(chunk)).alias("top_chunks"))
    ranked = W.partitionBy("query_id").orderBy(F.least(F.col("score"), F.lit(1.0)).desc(), "document_id")
    named = grouped.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("文档 "), F.col("document_id").cast("string"))), "n_documents": F.count(F.lit(1)).over(W.partitionBy("query_id")),
        "place": F.row_number().over(ranked).cast("long"), "score": F.least(F.col("score"), F.lit(1.0)),
    })
    return named.filter(F.col("place") <= limit)


def without_prefix(text: Column, length: Column) -> Column:
    """A text without its first characters, if it has so many and their number is over 0."""
    return F.when((length > 0) & (length <= F.length(text)), F.substr(text, length + 1)).otherwise(text)


def display_fields(title: Column, source_uri: Column, metadata: Column) -> Column:
    """entity_name, form, filed, accn, cik of a document: its metadata first, then its title line, then its file name."""
    own = lambda *keys: F.coalesce(*[F.nullif(F.trim(metadata[k]), F.lit("")) for k in keys])
    file = F.coalesce(source_uri, title)
    found = lambda text, pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(
        F.coalesce(own("entity_name", "entityName"), F.lit("")).alias("entity_name"), F.coalesce(own("form", "sec_form"), found(title, TITLE_LINE, 1), F.lit("")).alias("form"), F.coalesce(own("filed", "sec_filing_date"), F.lit("")).alias("filed"),
        F.coalesce(own("sec_accession", "accn"), found(title, TITLE_LINE, 2), found(file, FILE_NAME, 2), F.lit("")).alias("accn"), F.coalesce(metadata["cik"], found(file, FILE_NAME, 1)).alias("cik"),
    )


def display_name(document_id: Column, title: Column, source_uri: Column, fields: Column) -> Column:
    """Entity, form and date with the accession, else the accession, the file's name, the title, or the id."""
    base = F.array_join(F.filter(F.array(fields["entity_name"], fields["form"], fields["filed"]), lambda x: x != ""), " · ")
    label = F.when((fields["accn"] != "") & ~base.contains(fields["accn"]), F.concat(base, F.lit(" · "), fields["accn"])).otherwise(base)
    name = F.regexp_extract(F.trim(F.coalesce(F.nullif(source_uri, F.lit("")), title, F.lit(""))), r"([^/]*)$", 1)
    bare = F.trim(F.coalesce(title, F.lit("")))
    return F.when(base != "", label).when(fields["accn"] != "", F.concat(F.lit("EDGAR · "), fields["accn"])).when(~name.isin("", ".", ".."), name).when(bare != "", bare).otherwise(F.concat(F.lit("Document "), document_id.cast("string")))


def subtitle(document_id: Column, file_type: Column, accn: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.concat(F.lit("ID "), document_id.cast("string")), F.nullif(file_type, F.lit("")), F.nullif(accn, F.lit("")))), " · ")


def once_by_url(rows: DataFrame, url: str, order: list[str]) -> DataFrame:
    """Of rows that share a URL the first; blank and null URLs are never shared."""
    w = W.partitionBy(url).orderBy(*order)
    blank = rows.filter(F.coalesce(F.trim(url), F.lit("")) == "")
    return rows.filter(F.trim(url) != "").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").unionByName(blank)


def most_frequent(rows: DataFrame, value: str, limit: int) -> DataFrame:
    """value, n of the most frequent values that aren't blank, ties by value."""
    return rows.filter(F.trim(value) != "").groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(max(1, limit))


def distinct_values(rows: DataFrame, value: str, limit: int) -> DataFrame:
    """Values in order, 1 to 5000 of them."""
    return rows.select(value).filter(F.col(value).isNotNull()).distinct().orderBy(value).limit(min(5000, max(1, limit)))
