"""Queries over a document library; orders, pages and documents play its entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import library, search
from lodestone.session import table


def _entries(spark, sf_dir):
    """Orders as documents: customers as books, with metadata, titles and file names of several shapes."""
    k = F.col("o_orderkey")
    accn = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-20-"), F.lpad((k % 999).cast("string"), 6, "0"))
    pair = lambda name, value: F.struct(F.lit(name).alias("k"), value.cast("string").alias("v"))
    pairs = F.filter(
        F.array(
            pair("source", F.when(k % 3 == 0, "multimodal_pdf").otherwise("edgar")), pair("status", F.element_at(F.array(*map(F.lit, ("completed", "ingesting", "failed", "gone"))), (k % 4 + 1).cast("int"))), pair("book_id", F.concat(F.lit("b"), F.col("o_custkey").cast("string"))),
            pair("chapter_index", F.when(k % 5 == 0, "intro").when(k % 5 < 4, (k % 17).cast("string"))), pair("entity_name", F.when(k % 7 == 0, F.concat(F.lit(" Acme "), F.col("o_custkey").cast("string")))), pair("form", F.when(k % 14 == 0, "10-K")), pair("accn", F.when(k % 10 == 0, accn)),
        ),
        lambda p: p["v"].isNotNull(),
    )
    title = F.when(k % 6 == 1, F.concat(F.lit("EDGAR 10-Q | "), accn)).when(k % 6 == 2, F.lit(" A title "))
    uri = F.when(k % 6 == 3, F.concat(F.lit("s3://x/EDGAR_"), F.col("o_custkey").cast("string"), F.lit("_"), accn, F.lit(".htm"))).when(k % 6 == 4, F.concat(F.lit("/data/file"), k.cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), title.alias("title"), uri.alias("source_uri"), F.map_from_entries(pairs).alias("metadata"))


def library_inventory(spark, sf_dir):
    """Finished and unfinished entries of the library in reading order."""
    found = library.inventory(_entries(spark, sf_dir), "multimodal_pdf")
    return found.select("document_id", "status", "book_id", F.col("chapter_index").cast("long").alias("chapter_index"), "place")


def display_names(spark, sf_dir):
    held = _entries(spark, sf_dir).withColumn("f", library.display_fields(F.col("title"), F.col("source_uri"), F.col("metadata")))
    name = library.display_name(F.col("document_id"), F.col("title"), F.col("source_uri"), F.col("f"))
    return held.select("document_id", name.alias("name"), library.subtitle(F.col("document_id"), F.when(F.col("document_id") % 2 == 0, "pdf"), F.col("f.accn")).alias("subtitle"), "f.cik")


def hits_by_document(spark, sf_dir):
    """Hits of questions among documents, ten of which make a book."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "source", "text")
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    top = search.ranked(search.bm25(asked, docs), "score", "node_id", ["query_id"], 50)
    n = F.col("node_id")
    hits = F.broadcast(top).join(docs, "node_id").select("query_id", F.floor(n / 10).alias("document_id"), "node_id", F.round(F.col("score") / 20, 6).alias("score"), F.when(n % 3 > 0, F.col("source")).alias("title"), "text", (n % 10).alias("order_index"))
    found = library.documents_of_hits(hits, 12)
    chunks = F.array_join(F.transform("top_chunks", lambda c: F.concat_ws(":", c["section_number"].cast("string"), c["node_id"].cast("string"), F.length(c["text_preview"]).cast("string"))), ";")
    return found.select("query_id", "document_id", "title", "score", chunks.alias("chunks"), "place", "n_documents")


def pages_once_by_url(spark, sf_dir):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 > 0, bare).when(F.col("page_id") % 2 == 0, " ").alias("url"))
    return library.once_by_url(pages, "url", ["page_id"])


QUERIES = {f.__name__: f for f in (library_inventory, display_names, hits_by_document, pages_once_by_url)}

_ENTRIES = """e AS (SELECT o_orderkey AS k, o_custkey AS c, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-20-' || lpad(CAST(o_orderkey % 999 AS VARCHAR), 6, '0') AS a FROM orders)"""
ORACLES = {
    "library_inventory": f"""WITH {_ENTRIES}, x AS (SELECT k AS document_id, ['completed', 'ingesting', 'failed', 'gone'][k % 4 + 1] AS status, 'b' || c AS book_id, CASE WHEN k % 5 BETWEEN 1 AND 3 THEN k % 17 END AS chapter_index FROM e WHERE k % 3 = 0)
      SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index NULLS LAST, document_id) AS place FROM x WHERE status <> 'gone'""",
    "display_names": f"""WITH {_ENTRIES}, x AS (SELECT k, CASE k % 6 WHEN 1 THEN 'EDGAR 10-Q | ' || a WHEN 2 THEN ' A title ' END AS title, CASE k % 6 WHEN 3 THEN 's3://x/EDGAR_' || c || '_' || a || '.htm' WHEN 4 THEN '/data/file' || k || '.pdf' END AS uri,
        CASE WHEN k % 7 = 0 THEN 'Acme ' || c END AS entity, CASE WHEN k % 14 = 0 THEN '10-K' WHEN k % 6 = 1 THEN '10-Q' END AS form, CASE WHEN k % 10 = 0 OR k % 6 IN (1, 3) THEN a END AS accn, CASE WHEN k % 6 = 3 THEN CAST(c AS VARCHAR) END AS cik FROM e),
      y AS (SELECT *, concat_ws(' · ', entity, form) AS base FROM x)
      SELECT k AS document_id, CASE WHEN base <> '' THEN base || coalesce(' · ' || accn, '') WHEN accn IS NOT NULL THEN 'EDGAR · ' || accn WHEN k % 6 = 4 THEN 'file' || k || '.pdf' WHEN k % 6 = 2 THEN 'A title' ELSE 'Document ' || k END AS name,
        concat_ws(' · ', 'ID ' || k, CASE WHEN k % 2 = 0 THEN 'pdf' END, accn) AS subtitle, cik FROM y""",
    "hits_by_document": """WITH words AS (SELECT doc_id AS node_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM words),
      asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 100 = 0),
      tf AS (SELECT node_id, term, length, count(*) AS tf FROM (SELECT node_id, len(w) AS length, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), corpus GROUP BY ALL),
      t AS (SELECT query_id, node_id // 10 AS document_id, node_id, round(score / 20, 6) AS score, CASE WHEN node_id % 3 > 0 THEN source END AS title, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) JOIN documents ON doc_id = node_id WHERE rank <= 50),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, node_id) AS n FROM t),
      g AS (SELECT query_id, document_id, coalesce(max(CASE WHEN n = 1 THEN title END), '文档 ' || document_id) AS title, least(1.0, max(score)) AS score, string_agg((node_id % 10 + 1) || ':' || node_id || ':' || least(200, length(text)), ';' ORDER BY n) AS chunks FROM o WHERE n <= 3 GROUP BY query_id, document_id)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS place, count(*) OVER (PARTITION BY query_id) AS n_documents FROM g) WHERE place <= 12""",
    "pages_once_by_url": """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 > 0 THEN regexp_replace(url, '[?#].*$', '') WHEN page_id % 2 = 0 THEN ' ' END AS url FROM pages)
      SELECT page_id, url FROM p WHERE coalesce(trim(url), '') = '' UNION ALL SELECT min(page_id), url FROM p WHERE trim(url) <> '' GROUP BY url""",
}
