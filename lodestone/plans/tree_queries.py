"""Retrieval over the section tree of the documents: a node for each document, each four lines and each line."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import hierarchical, planning
from lodestone.session import stored, table

#: Lines of a section.
LINES = 4
#: A line up to this length counts as a heading.
HEADING = 60


def nodes_of(docs):
    """docs(doc_id, source, text) as a tree: d<doc> (level 1), s<doc>.<section> (level 2), l<doc>.<line> (level 0), numbered among the lines with a character other than a space."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    held = docs.select("doc_id", "source", lines.alias("lines"))
    doc, name = F.col("doc_id").cast("string"), lambda kind, *parts: F.concat(F.lit(kind), F.concat_ws(".", *parts))
    rows = held.select("doc_id", "source", F.posexplode("lines").alias("i", "text"))
    line, section = F.col("i").cast("string"), F.floor(F.col("i") / LINES)
    columns = lambda node, parent, level, order, text: (node.alias("node_id"), F.col("doc_id").alias("document_id"), parent.cast("string").alias("parent_id"), F.lit(level).cast("long").alias("level"), order.cast("long").alias("order_index"), "source", text.alias("text"))
    documents = held.select(*columns(name("d", doc), F.lit(None), 1, F.lit(0), F.concat_ws(" ", "source", F.get("lines", F.lit(0)))))
    sections = rows.filter(F.col("i") % LINES == 0).select(*columns(name("s", doc, section.cast("string")), name("d", doc), 2, section, F.col("text")))
    leaves = rows.select(*columns(name("l", doc, line), name("s", doc, section.cast("string")), 0, F.col("i"), F.col("text")))
    return documents.unionByName(sections).unionByName(leaves)


def _asked(spark, sf_dir, every):
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, sf_dir, asked):
    """Vectors of the documents, by the document node; a question has that of its own number."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = rows.join(F.broadcast(asked.select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi")
    return own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), rows.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("node_id"), F.col("embedding").alias("vector"))


def _rerank(nodes):
    """Stands for a model: a number made of the text's length."""
    sizes = nodes.select("node_id", F.round(1 / (1 + F.length("text") % 97), 6).alias("rerank_score"))
    return lambda hits: hits.join(sizes, "node_id")


def _setting(spark, sf_dir, every):
    # Stored once: a dozen steps read nodes, most of them without texts, and would cut all texts into lines each time.
    nodes = stored(nodes_of(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    asked = _asked(spark, sf_dir, every)
    return nodes, asked, _vectors(spark, sf_dir, asked)


def hierarchical_search(spark, sf_dir, every=100):
    """Sections and leaves searched apart, children of the sections found, fused, reranked, with siblings."""
    nodes, asked, vectors = _setting(spark, sf_dir, every)
    found = hierarchical.retrieve(asked, nodes, hierarchical.Budget(), vectors, rerank=_rerank(nodes))
    return found.withColumn("score", F.round("score", 6))


def scoped_search(spark, sf_dir, every=100):
    """The same in the documents whose year and form the question names: documents have the year 2020 + doc_id % 5 and a form by language."""
    nodes, asked, vectors = _setting(spark, sf_dir, every)
    asked = asked.withColumn("query", F.concat_ws(" ", "query", F.lit("annual report"), (2020 + F.floor(F.col("query_id") / every) % 7).cast("string")))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array((2020 + F.col("doc_id") % 5).cast("string")).alias("years"), F.array(F.when(F.col("lang") == "en", "10-K").otherwise("10-Q")).alias("forms"))
    scope = planning.narrowed(documents, asked.select("query_id", planning.scope(F.col("query")).alias("s")).select("query_id", "s.*"))
    scope = scope.filter("document_id is not null")
    found = hierarchical.retrieve(asked, nodes, hierarchical.Budget(), vectors, scope, _rerank(nodes))
    return found.withColumn("score", F.round("score", 6))


def section_expansion(spark, sf_dir, every=100):
    """Children of the sections found with their sections' scores, and what follows the headings among the leaves found."""
    nodes, asked, vectors = _setting(spark, sf_dir, every)
    budget = hierarchical.Budget()
    small = budget.hint(asked)
    sections = hierarchical.branch(asked, nodes.filter("level > 0"), budget, budget.summary, "summary", vectors, small=small)
    leaves = hierarchical.branch(asked, nodes.filter("level = 0"), budget, budget.leaf, "leaf", small=small)
    heads = leaves.join(nodes.filter(F.length("text") <= HEADING).select("node_id"), "node_id", "left_semi")
    more = hierarchical.following_siblings(heads, nodes, budget.per_heading, small)
    merged = hierarchical.merged_candidates(leaves, hierarchical.scored_children(nodes, sections, small).drop("rank"), 4 * budget.fused())
    both = hierarchical.merged_candidates(merged, more, 4 * budget.fused())
    return both.select("query_id", "node_id", "bucket", "rank", F.round(F.coalesce("sparse_score", "fusion_score"), 6).alias("score"))


QUERIES = {f.__name__: f for f in (hierarchical_search, scoped_search, section_expansion)}


def _search_cte(name: str, levels: str, limit: int, dense: bool, asked: str = "asked") -> str:
    """A branch in SQL: <name> holds its hits with `rank`, `fusion_score` and the scores."""
    hits = f"{name}_sparse"
    near = f"""{name}_pairs AS (SELECT a.query_id, n.node_id, round(list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) AS score
  FROM {asked} a JOIN embeddings w ON w.vec_id = a.query_id CROSS JOIN embeddings v JOIN nodes n ON n.node_id = 'd' || v.vec_id WHERE {levels} AND {{scope}}),
{name}_dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM {name}_pairs),
"""
    return f"""
{name}_words AS (SELECT node_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM nodes n WHERE {levels}),
{name}_size AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM {name}_words),
{name}_terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {asked}),
{name}_tf AS (SELECT node_id, term, length, count(*) AS tf FROM (SELECT node_id, len(w) AS length, unnest(w) AS term FROM {name}_words) WHERE term IN (SELECT term FROM {name}_terms) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_bm25 AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_terms USING (term), {name}_size GROUP BY ALL),
{hits} AS (SELECT a.query_id, node_id, score, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, node_id) AS rank FROM {name}_bm25 a JOIN nodes n USING (node_id) WHERE {{scope}}),
{near if dense else ""}
{name}_lists AS ({f"SELECT query_id, node_id, rank, 0 AS list_no, score AS dense_score, NULL::DOUBLE AS sparse_score FROM {name}_dense WHERE rank <= 30 UNION ALL " if dense else ""}
  SELECT query_id, node_id, rank, {int(dense)} AS list_no, NULL::DOUBLE AS dense_score, score AS sparse_score FROM {hits} WHERE rank <= 30),
{name}_sums AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score, min(list_no * 100000 + rank) AS seen, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score FROM {name}_lists GROUP BY ALL),
{name}_ranked AS (SELECT s.*, n.* EXCLUDE (node_id), row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, level DESC, seen, node_id) AS r FROM {name}_sums s JOIN nodes n USING (node_id)),
{name}_places AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY r) AS place FROM {name}_ranked WHERE r <= {max(limit, 6)}),
{name}_order AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 3 THEN 1 WHEN place <= {max(3, min(limit, 6))} THEN 2 ELSE 3 END, r) AS rank FROM {name}_places),
{name} AS (SELECT * FROM {name}_order WHERE rank <= {limit})"""


def _capped_cte(name: str, hits: str, limit: int, child_cap: int, leaf_cap: int) -> str:
    """The three-pass limit by source and bucket in SQL, one candidate after another."""
    soft = max(3, min(limit, 6))
    room = f"len(list_filter(c.sources, lambda x: x IS NOT DISTINCT FROM s.source)) < CASE s.pass WHEN 1 THEN 3 ELSE {soft} END AND len(list_filter(c.buckets, lambda x: x = s.bucket)) < CASE s.bucket WHEN 'leaf' THEN {leaf_cap} ELSE {child_cap} END"
    takes = f"NOT list_contains(c.taken, s.node_id) AND len(c.taken) < {limit} AND (s.pass = 3 OR ({room}))"
    return f"""
{name}_steps AS (SELECT query_id, node_id, source, bucket, pass, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank, node_id) AS n FROM {hits}, (SELECT unnest([1, 2, 3]) AS pass)),
{name}_walk AS (
  SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS taken, []::VARCHAR[] AS sources, []::VARCHAR[] AS buckets FROM {hits}
  UNION ALL
  SELECT c.query_id, s.n, CASE WHEN {takes} THEN list_append(c.taken, s.node_id) ELSE c.taken END, CASE WHEN {takes} THEN list_append(c.sources, s.source) ELSE c.sources END, CASE WHEN {takes} THEN list_append(c.buckets, s.bucket) ELSE c.buckets END
  FROM {name}_walk c JOIN {name}_steps s ON s.query_id = c.query_id AND s.n = c.n + 1),
{name}_taken AS (SELECT query_id, arg_max(taken, n) AS taken FROM {name}_walk GROUP BY query_id),
{name} AS (SELECT h.* EXCLUDE (rank), list_position(taken, node_id) AS rank FROM {hits} h JOIN {name}_taken USING (query_id) WHERE list_contains(taken, node_id))"""


def _nodes_cte(every: int, query: str = "text") -> str:
    return rf"""
asked AS (SELECT item_id AS query_id, {query} AS query FROM benchmark WHERE item_id % {every} = 0),
held AS (SELECT doc_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
numbered AS (SELECT doc_id, source, unnest(range(len(lines))) AS i, unnest(lines) AS text FROM held),
nodes AS (
  SELECT 'd' || doc_id AS node_id, doc_id AS document_id, NULL::VARCHAR AS parent_id, 1::BIGINT AS level, 0::BIGINT AS order_index, source, concat_ws(' ', source, lines[1]) AS text FROM held
  UNION ALL SELECT 's' || doc_id || '.' || (i // 4), doc_id, 'd' || doc_id, 2, i // 4, source, text FROM numbered WHERE i % 4 = 0
  UNION ALL SELECT 'l' || doc_id || '.' || i, doc_id, 's' || doc_id || '.' || (i // 4), 0, i, source, text FROM numbered)"""


def _retrieve_sql(every: int, query: str = "text", scope: str = "true", before: str = "") -> str:
    return f"""WITH RECURSIVE {_nodes_cte(every, query)},{before}
{_search_cte("summary", "n.level > 0", 6, True).replace("{scope}", scope)},
{_search_cte("leaf", "n.level = 0", 20, True).replace("{scope}", scope)},
below AS (SELECT s.query_id, s.rank AS of, n.*, row_number() OVER (PARTITION BY s.query_id, n.parent_id ORDER BY n.order_index, n.node_id) AS place FROM nodes n JOIN summary s ON s.node_id = n.parent_id),
children AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, order_index, of, node_id) AS rank FROM below WHERE place <= 20),
lists AS (SELECT query_id, node_id, rank, 0 AS list_no, 'leaf' AS bucket, dense_score, sparse_score FROM leaf UNION ALL SELECT query_id, node_id, rank, 1, 'summary_child', NULL, NULL FROM children),
sums AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score, min(list_no * 100000 + rank) AS seen, arg_min(bucket, list_no) AS bucket, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score FROM lists GROUP BY ALL),
fused AS (SELECT * FROM (SELECT s.*, n.* EXCLUDE (node_id), row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, level DESC, seen, node_id) AS rank FROM sums s JOIN nodes n USING (node_id)) WHERE rank <= 30),
{_capped_cte("pre", "fused", 30, 6, 20)},
scored AS (SELECT * EXCLUDE (rank), round(1 / (1 + length(text) % 97), 6) AS rerank_score, rank AS was FROM pre),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, was, node_id) AS rank FROM scored) WHERE rank <= 12),
{_capped_cte("final", "best", 12, 6, 20)},
beside AS (SELECT f.query_id, f.rank AS seed, f.rerank_score * 0.8 AS score, n.*, row_number() OVER (PARTITION BY f.query_id, f.rank ORDER BY n.order_index, n.node_id) AS place FROM final f JOIN nodes n ON n.parent_id = f.parent_id AND n.level = 0 WHERE f.rank <= 3),
context AS (SELECT query_id, node_id, document_id, level, order_index, 'ranked' AS origin, rerank_score AS score, 0 AS seed FROM final
  UNION ALL SELECT query_id, node_id, document_id, level, order_index, 'sibling', score, seed FROM beside WHERE place <= 8)
SELECT query_id, node_id, document_id, level, order_index, origin, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY seed) AS n FROM context) WHERE n = 1"""


def hierarchical_sql(every: int = 100) -> str:
    return _retrieve_sql(every)


def scoped_sql(every: int = 100) -> str:
    years = f"2020 + (item_id // {every}) % 7"
    before = f"""
years AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text || ' annual report ' || CAST({years} AS VARCHAR), '20[0-9][0-9]'), lambda y: CAST(y AS BIGINT)) AS ys FROM benchmark WHERE item_id % {every} = 0),
pairs AS (SELECT query_id, doc_id FROM years, documents WHERE list_contains(ys, 2020 + doc_id % 5) AND lang = 'en'),"""
    scope = "(a.query_id NOT IN (SELECT query_id FROM pairs) OR n.document_id IN (SELECT doc_id FROM pairs p WHERE p.query_id = a.query_id))"
    return _retrieve_sql(every, f"concat_ws(' ', text, 'annual report', CAST({years} AS VARCHAR))", scope, before)


def expansion_sql(every: int = 100) -> str:
    merge = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sparse_score, 0) DESC, coalesce(dense_score, 0) DESC, coalesce(fusion_score, 0) DESC, list_no, node_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY coalesce(nullif(sparse_score, 0), nullif(dense_score, 0), nullif(fusion_score, 0), 0) DESC, list_no) AS n FROM {both}) WHERE n = 1"""
    return f"""WITH {_nodes_cte(every)},
{_search_cte("summary", "n.level > 0", 6, True).replace("{scope}", "true")},
{_search_cte("leaf", "n.level = 0", 20, False).replace("{scope}", "true")},
heads AS (SELECT query_id, parent_id, min(order_index) AS first FROM leaf WHERE length(text) <= {HEADING} GROUP BY ALL),
more AS (SELECT h.query_id, n.node_id, row_number() OVER (PARTITION BY h.query_id, n.parent_id ORDER BY n.order_index, n.node_id) AS place FROM heads h JOIN nodes n ON n.parent_id = h.parent_id AND n.order_index >= h.first),
kids AS (SELECT s.query_id, n.node_id, greatest(0.2, coalesce(nullif(greatest(coalesce(s.dense_score, 0), coalesce(s.sparse_score, 0)), 0), s.fusion_score)) AS fusion_score FROM summary s JOIN nodes n ON n.parent_id = s.node_id),
one AS (SELECT query_id, node_id, 'leaf' AS bucket, sparse_score, dense_score, fusion_score, 0 AS list_no FROM leaf UNION ALL SELECT query_id, node_id, 'section_child', NULL, NULL, fusion_score, 1 FROM kids),
merged AS (SELECT * FROM ({merge.replace("{both}", "one")}) WHERE rank <= 120),
two AS (SELECT query_id, node_id, bucket, sparse_score, dense_score, fusion_score, 0 AS list_no FROM merged UNION ALL SELECT query_id, node_id, 'section_sibling', NULL, NULL, NULL, 1 FROM more WHERE place <= 6)
SELECT query_id, node_id, bucket, rank, round(coalesce(sparse_score, fusion_score), 6) AS score FROM ({merge.replace("{both}", "two")}) WHERE rank <= 120"""


ORACLES = {"hierarchical_search": hierarchical_sql(), "scoped_search": scoped_sql(), "section_expansion": expansion_sql()}
