"""Text, page and library queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import narrative
from lodestone.functions import text as T
from lodestone.operators import planning, trees
from lodestone.plans.questions import ASKED_SQL, asked_of_orders
from lodestone.session import table
from lodestone.sources.html import visible_text


def section_tree(spark, sf_dir):
    """Sections of each site, by the parts of its pages' paths."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    parts = F.filter(F.split(F.regexp_replace(url, r"^https?://[^/]*", ""), "/"), lambda p: p != "")
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("host"), F.slice(parts, 1, 2).alias("path"), F.col("page_id").alias("position"))
    found = trees.section_tree(paths, ["host"])
    return found.select("host", F.array_join("prefix", "/").alias("section"), F.col("level").cast("long").alias("level"), "first_position", "leaves", "order_index")


def html_title_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


def html_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", visible_text("html").alias("text"))


def table_density(spark, sf_dir):
    """Share of numeric cells, and whether a page's tables read like financial ones."""
    cells = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"<td>([^<]*)</td>"), F.lit(1)), lambda c: F.trim(c)), lambda c: c != "")
    numeric = F.size(F.filter(cells, lambda c: c.rlike(r"^[$(]?[0-9][0-9,.]*[%)]?$")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.size(cells).cast("long").alias("n_cells"), numeric.cast("long").alias("n_numeric"))
    return rows.withColumn("financial", (F.col("n_cells") >= 6) & (F.col("n_numeric") >= 0.3 * F.col("n_cells")))


def text_quality(spark, sf_dir):
    """Sentences, causal phrases and tables by quality label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(T.sentence_count(F.col("text"))), 6).alias("sentences"),
        F.round(F.avg(T.causal_signals(F.col("text"))), 6).alias("causal"), F.round(F.avg(F.length("text")), 6).alias("mean_length"),
    )


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(narrative.selector_key(F.col("text"))).alias("key"))


def dedup_prefix(spark, sf_dir):
    """Of documents that begin with the same 200 characters the first."""
    w = W.partitionBy(F.left("text", F.lit(200))).orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(w)).filter("n = 1").select("doc_id")


def trigram_overlap(spark, sf_dir):
    """Shared character trigrams of items that share any; pairs come from an inverted list."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.trigrams(F.col("text"))).alias("t"))
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    other = items.select(F.col("item_id").alias("other_id"), "t")
    shared = items.join(other, "t").filter("item_id < other_id").groupBy("item_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))
    joined = shared.join(sizes, "item_id").join(sizes.select(F.col("item_id").alias("other_id"), F.col("n").alias("m")), "other_id")
    return joined.select("item_id", "other_id", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("jaccard"))


def facets(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    lines = F.sort_array(F.collect_list(F.concat("lang", F.lit("="), F.col("n").cast("string"))))
    return by.groupBy("source").agg(F.array_join(lines, ",").alias("langs"), F.sum("n").alias("n"))


def set_staleness(spark, sf_dir):
    """Per quality set: labels and how many name no document."""
    known = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("known"))
    joined = table(spark, sf_dir, "labels").join(known, "doc_id", "left")
    return joined.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("stale"))


def reconcile_orphans(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    orphans = docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("side"))
    return orphans.unionByName(labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("side")))


def stratified_sample(spark, sf_dir):
    """One row of each source and language in turn, in a fixed order, until 100 are taken."""
    cell = F.row_number().over(W.partitionBy("source", "lang").orderBy(F.md5(F.col("doc_id").cast("string")))).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", cell.alias("round"))
    return rows.orderBy("round", "source", "lang").limit(100)


def page_offset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("size")).orderBy("source", "doc_id").offset(40).limit(20)


def query_scope(spark, sf_dir):
    """Years, forms, sections and how questions compare, of a question made from every order."""
    asked = asked_of_orders(spark, sf_dir).withColumn("scope", planning.scope(F.col("question")))
    texts = {c: F.array_join(f"scope.{c}", ",") for c in ("periods", "forms", "sections")}
    q = F.col("question")
    return asked.select("query_id", *[c.alias(n) for n, c in texts.items()], F.col("scope.explicit").alias("explicit"), T.compare_mode(q).alias("compare_mode"), T.prefers_recent(q).alias("prefer_recent"))


def scope_narrowing(spark, sf_dir):
    """Customers whose orders have a year and a form that a question about 1 of 60 combinations names; none where none do."""
    documents = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(
        F.collect_set((F.year("o_orderdate") + 10).cast("string")).alias("years"), F.collect_set(F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").otherwise("10-Q")).alias("forms")
    )
    words = F.concat_ws(" ", F.lit("Risk"), F.when(F.col("n_nationkey") % 3 > 0, (F.col("n_nationkey") % 9 + 2002).cast("string")), F.when(F.col("n_nationkey") % 2 > 0, F.lit("annual report")))
    scopes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), planning.scope(words).alias("s")).select("query_id", "s.*")
    return planning.narrowed(documents, scopes)


def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 80).alias("preview"))


QUERIES = {f.__name__: f for f in (section_tree, html_title_counts, html_visible_text, table_density, text_quality, normalize_text, dedup_prefix, trigram_overlap, facets, set_staleness, reconcile_orphans, stratified_sample, page_offset, query_scope, scope_narrowing, previews)}
ORACLES = {
    "section_tree": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
        list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '/'), lambda x: x <> '')[1:2] AS path FROM pages),
      x AS (SELECT host, page_id, unnest(range(1, len(path) + 1)) AS level, path FROM p),
      g AS (SELECT host, array_to_string(path[1:level], '/') AS section, level, min(page_id) AS first_position, count(*) AS leaves FROM x GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY host ORDER BY first_position, level) - 1 AS order_index FROM g""",
    "html_title_counts": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages",
    "table_density": r"""WITH c AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<td>([^<]*)</td>', 1), lambda x: trim(x)), lambda x: x <> '') AS cells FROM pages),
      n AS (SELECT page_id, len(cells) AS n_cells, len(list_filter(cells, lambda x: regexp_matches(x, '^[$(]?[0-9][0-9,.]*[%)]?$'))) AS n_numeric FROM c)
      SELECT *, n_cells >= 6 AND n_numeric >= 0.3 * n_cells AS financial FROM n""",
    "text_quality": r"""SELECT quality, count(*) AS n, round(avg(len(regexp_extract_all(text, '[.!?](\s|$)'))), 6) AS sentences,
      round(avg(list_sum(list_transform(['because', 'due to', 'as a result', 'driven by', 'primarily', 'resulted in'], lambda p: CAST(contains(lower(text), p) AS INTEGER)))), 6) AS causal,
      round(avg(length(text)), 6) AS mean_length FROM documents JOIN labels USING (doc_id) GROUP BY quality""",
    "normalize_text": r"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
      b AS (SELECT doc_id, replace(regexp_replace(t, '[a-z][a-z0-9 .,&''/-]*\|\s*q[1-4][^|\n]*form\s+10-[kq]\s*\|\s*\d+', ' ', 'g'), 'table |', ' table ') AS t FROM a),
      c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b(first|second|third|fourth|three|six|nine|twelve)\s+(quarter|months?)\b', ' ', 'g'), '\bq[1-4]\b', ' ', 'g') AS t FROM b),
      d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b20\d{2}\b', ' <year> ', 'g'), '\b\d[\d,.\-$()%]*\b', ' <num> ', 'g') AS t FROM c)
      SELECT doc_id, md5(left(trim(regexp_replace(t, '\s+', ' ', 'g')), 1200)) AS key FROM d""",
    "dedup_prefix": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(text, 200)",
    "trigram_overlap": r"""WITH b AS (SELECT item_id, regexp_replace(lower(text), '[ \t\n\r]+', '', 'g') AS t FROM benchmark),
      g AS (SELECT DISTINCT item_id, substr(t, i, 3) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 1)) AS i FROM b)), s AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1),
      p AS (SELECT a.item_id, b.item_id AS other_id, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY ALL)
      SELECT p.item_id, other_id, round(shared / (s.n + r.n - shared), 6) AS jaccard FROM p JOIN s USING (item_id) JOIN s r ON r.item_id = other_id""",
    "facets": "SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang || '=' || n) AS langs, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
    "set_staleness": "SELECT quality, count(*) AS n, count(*) FILTER (WHERE d.doc_id IS NULL) AS stale FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY quality",
    "reconcile_orphans": "SELECT doc_id, 'unlabelled' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "stratified_sample": "SELECT doc_id, source, lang, round FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS round FROM documents) ORDER BY round, source, lang LIMIT 100",
    "page_offset": "SELECT doc_id, source, length(text) AS size FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 40",
    "query_scope": rf"""WITH {ASKED_SQL}, l AS (SELECT *, lower(t) AS low, regexp_extract_all(regexp_replace(t, '(?i)\b(ASU|Item) 20[0-9][0-9]', '~', 'g'), '20[0-9][0-9]') AS y FROM q)
      SELECT query_id, array_to_string(list_filter(y, lambda x, i: list_position(y, x) = i), ',') AS periods,
             concat_ws(',', CASE WHEN regexp_matches(low, '\b10-?ks?\b') OR contains(low, 'annual report') OR contains(t, '年报') THEN '10-K' END, CASE WHEN regexp_matches(low, '\b10-?qs?\b') OR contains(low, 'quarterly report') THEN '10-Q' END) AS forms,
             concat_ws(',', CASE WHEN contains(low, 'management discussion') THEN 'management_discussion' END, CASE WHEN contains(low, 'risk factor') THEN 'risk_factors' END, CASE WHEN contains(low, 'liquidity') THEN 'liquidity' END) AS sections,
             len(y) > 0 OR regexp_matches(low, '\b10-?[kq]s?\b|annual report|quarterly report|年报') AS explicit, compares AS compare_mode, compares IN ('latest', 'point_in_time') OR regexp_matches(low, '\b(latest|most recent|newest|filed)\b') AS prefer_recent FROM l""",
    "scope_narrowing": """WITH d AS (SELECT o_custkey AS document_id, year(o_orderdate) + 10 AS y, o_orderpriority = '1-URGENT' AS annual FROM orders),
      s AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 9 + 2002 END AS y, n_nationkey % 2 > 0 AS k FROM nation),
      p AS (SELECT query_id, document_id FROM s JOIN d ON d.y = s.y), f AS (SELECT query_id, document_id FROM s JOIN d ON s.k AND d.annual),
      h AS (SELECT query_id, document_id FROM p WHERE query_id IN (SELECT query_id FROM s WHERE NOT k) UNION SELECT query_id, document_id FROM f WHERE query_id IN (SELECT query_id FROM s WHERE y IS NULL) UNION (SELECT * FROM p INTERSECT SELECT * FROM f))
      SELECT s.query_id, h.document_id FROM s LEFT JOIN h USING (query_id)""",
    "previews": "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(left(text, 77), ' ') || '...' END AS preview FROM documents",
}
