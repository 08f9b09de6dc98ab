"""Quotes held against passages; documents play the passages of questions, twenty each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import quotes
from lodestone.session import settled, table


def quotes_verified(spark, sf_dir):
    """Two quotes of every passage that a question shows: short, from a table, changed, of no passage, repeated or sound, by its number."""
    i = F.col("doc_id")
    nodes = table(spark, sf_dir, "documents").select(
        F.floor(i / 20).alias("query_id"), i.alias("node_id"), F.when(i % 19 > 0, F.floor(i / 3)).alias("document_id"), "text", ((i * 37 % 100) / 100).alias("score"), F.when(i % 4 > 0, (i * 53 % 100) / 100).alias("rerank_score"),
        F.when(i % 3 == 1, F.array(F.concat(F.lit("a"), i.cast("string")), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("accns"),
    )
    seen = settled(quotes.sources(nodes))
    n, k = F.col("source_index"), F.col("k")
    part = lambda at, size: F.substr("excerpt", at, F.lit(size))
    text = F.when(n % 8 == 0, part(F.lit(1), 30)).when(n % 8 == 1, F.lit("a | b | c\nd | e | f padded until it is long enough")).when(n % 8 == 2, F.upper(part(F.lit(1), 100))).otherwise(part(F.when((k == 1) & (n % 3 > 0), 40).otherwise(11), 80))
    given = seen.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("query_id", (2 * n + k).alias("position"), F.when(n % 8 == 4, n + 100).otherwise(n).alias("source_index"), text.alias("text"))
    return quotes.verified(given, seen).withColumn("body", F.md5("body"))


QUERIES = {f.__name__: f for f in (quotes_verified,)}
ORACLES = {
    "quotes_verified": r"""WITH n AS (SELECT doc_id // 20 AS query_id, doc_id AS node_id, CASE WHEN doc_id % 19 > 0 THEN doc_id // 3 END AS document_id, text, coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id * 53 % 100 / 100 END, doc_id * 37 % 100 / 100, 0) AS r, CASE WHEN doc_id % 3 = 1 THEN 'a' || doc_id END AS own FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, node_id) AS i FROM n),
      s AS (SELECT query_id, i, node_id, document_id, left(coalesce(text, ''), 7000) AS excerpt, round(r, 4) AS relevance,
        coalesce(own, CASE WHEN document_id IS NOT NULL THEN (SELECT arg_min(own, i) FROM o p WHERE p.query_id = o.query_id AND p.document_id = o.document_id AND p.i <= 12 AND p.own IS NOT NULL) END) AS accn FROM o WHERE i <= 12),
      q AS (SELECT query_id, 2 * i + k AS position, CASE WHEN i % 8 = 4 THEN i + 100 ELSE i END AS i, regexp_replace(CASE i % 8 WHEN 0 THEN substr(excerpt, 1, 30) WHEN 1 THEN 'a | b | c' || chr(10) || 'd | e | f padded until it is long enough' WHEN 2 THEN upper(substr(excerpt, 1, 100))
        ELSE substr(excerpt, CASE WHEN k = 1 AND i % 3 > 0 THEN 40 ELSE 11 END, 80) END, '^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$', '', 'g') AS t FROM s, (SELECT unnest([0, 1]) AS k)),
      l AS (SELECT *, list_filter(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')[1:16] AS lines FROM q),
      g AS (SELECT l.query_id, position, t, s.node_id, s.document_id, s.relevance, s.accn, CASE WHEN length(t) NOT BETWEEN 40 AND 1200 THEN 'length'
        WHEN len(lines) >= 2 AND len(list_filter(lines, lambda x: len(regexp_extract_all(x, '\|')) >= 2)) >= greatest(2, (len(lines) + 1) // 2) THEN 'table'
        WHEN s.node_id IS NULL THEN 'source' WHEN NOT contains(replace(excerpt, chr(13) || chr(10), chr(10)), replace(t, chr(13) || chr(10), chr(10))) THEN 'not verbatim' END AS gate FROM l LEFT JOIN s ON s.query_id = l.query_id AND s.i = l.i),
      d AS (SELECT * EXCLUDE (gate), coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY query_id, left(regexp_replace(lower(t), '\s+', ' ', 'g'), 400), gate IS NULL ORDER BY position) > 1 THEN 'repeated' END, CASE WHEN document_id IS NULL THEN 'no document' END) AS gate FROM g),
      p AS (SELECT *, CASE WHEN gate IS NULL THEN count(*) FILTER (WHERE gate IS NULL) OVER (PARTITION BY query_id ORDER BY position) END AS place FROM d),
      v AS (SELECT *, coalesce(gate, CASE WHEN place > 3 THEN 'beyond' END, 'kept') AS verdict FROM p)
      SELECT query_id, position, verdict, CASE WHEN verdict = 'kept' THEN md5(t) END AS body, CASE WHEN verdict = 'kept' THEN document_id END AS document_id, CASE WHEN verdict = 'kept' THEN node_id END AS node_id, CASE WHEN verdict = 'kept' THEN relevance END AS relevance,
        CASE WHEN verdict = 'kept' THEN accn END AS accn, CASE WHEN verdict = 'kept' THEN place END AS place, CASE WHEN verdict = 'kept' THEN CASE WHEN relevance >= 0.55 THEN 'high' WHEN relevance >= 0.35 THEN 'medium' ELSE 'low' END END AS level FROM v""",
}
