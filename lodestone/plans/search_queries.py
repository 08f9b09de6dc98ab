"""Retrieval queries over documents and embeddings. Query sets are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import enriched
from lodestone.operators import evaluation, search
from lodestone.session import table

TOP = 10

#: Common table expressions of the SQL forms.
_VECTORS = """
q AS (SELECT vec_id AS query_id, label AS query_label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, query_label, vec_id AS node_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, q),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored)
"""


def _bm25_cte(docs: str) -> str:
    return f"""
words AS (SELECT doc_id AS node_id, source, regexp_extract_all(lower({docs}), '[a-z0-9]+') AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM words),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 100 = 0),
tokens AS (SELECT node_id, len(w) AS length, unnest(w) AS term FROM words),
tf AS (SELECT node_id, term, length, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sparse_scored AS (
  SELECT query_id, node_id, count(*) AS matched,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), corpus GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sparse_scored)
"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query_vector"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label", F.col("embedding").alias("vector"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "source", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def dense_topk(spark, sf_dir):
    return search.dense_topk(_queries(spark, sf_dir), _nodes(spark, sf_dir), TOP).select("query_id", "node_id", "rank", "score")


def dense_filtered(spark, sf_dir):
    found = search.dense_topk(_queries(spark, sf_dir), _nodes(spark, sf_dir), TOP, F.col("label").isin(0, 1, 2))
    return found.select("query_id", "node_id", "label", "rank", "score")


def bm25_topk(spark, sf_dir):
    scores = search.bm25(_questions(spark, sf_dir), _docs(spark, sf_dir))
    return search.ranked(scores, "score", "node_id", ["query_id"], TOP)


def bm25_enriched(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", enriched(F.col("source"), F.lit(None).cast("string"), F.col("text")))
    return search.ranked(search.bm25(_questions(spark, sf_dir), docs), "score", "node_id", ["query_id"], TOP)


def fts_all_terms(spark, sf_dir):
    """Every term of the query must match."""
    return search.ranked(search.bm25(_questions(spark, sf_dir), _docs(spark, sf_dir), match_all=True), "score", "node_id", ["query_id"])


def _two_lists(spark, sf_dir):
    queries, nodes = _queries(spark, sf_dir), _nodes(spark, sf_dir)
    dense = search.dense_topk(queries, nodes, 30)
    same = nodes.drop("vector").join(search.bounded(queries.select("query_id", "query_label")), F.col("label") == F.col("query_label"))
    return dense, search.ranked(same.withColumn("score", -F.abs(F.col("node_id") - F.col("query_id"))), "score", "node_id", ["query_id"], 30)


def rrf_fusion(spark, sf_dir):
    return search.rrf(list(_two_lists(spark, sf_dir))).select("query_id", "node_id", F.round("fusion_score", 9).alias("fusion_score"))


_LISTS = _VECTORS + """,
same AS (SELECT query_id, vec_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS rank
         FROM embeddings JOIN q ON label = query_label)
"""


def hybrid_search(spark, sf_dir):
    """BM25 and cosine lists of the same ids fused, at most 2 of a source before others."""
    asked = _questions(spark, sf_dir)
    sparse = search.ranked(search.bm25(asked, _docs(spark, sf_dir)), "score", "node_id", ["query_id"], 30)
    dense = search.dense_topk(_queries(spark, sf_dir).join(F.broadcast(asked.select("query_id")), "query_id", "left_semi"), _nodes(spark, sf_dir), 30)
    hits = search.fused([dense, sparse], 40).join(_docs(spark, sf_dir).select("node_id", "source"), "node_id")
    return search.source_limit(hits, TOP, 2, ["query_id"]).select("query_id", "node_id", "source", "fusion_score", "rank")


def filing_aware_limit(spark, sf_dir):
    """The longest documents of each language, at most 2 of a source before others."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("doc_id").alias("node_id"), F.length("text").alias("score"))
    return search.source_limit(search.ranked(docs, "score", "node_id", ["lang"]), 30, 1, ["lang"]).select("lang", "node_id", "source", "rank")


def strict_backfill(spark, sf_dir):
    """Good documents first, then others, by length."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    hits = docs.select("lang", F.col("doc_id").alias("node_id"), F.length("text").cast("long").alias("score"), "quality")
    return search.backfilled(hits, F.coalesce(F.col("quality") == 1, F.lit(False)), 20, ["lang"]).select("lang", "node_id", "matched", "score", "rank")


def rank_metrics(spark, sf_dir):
    """Vectors of a query's label are its gold."""
    queries, nodes = _queries(spark, sf_dir), _nodes(spark, sf_dir)
    gold = nodes.join(search.bounded(queries.select("query_id", "query_label")), F.col("label") == F.col("query_label")).select("query_id", "node_id")
    return evaluation.rank_metrics(search.dense_topk(queries, nodes, TOP), gold, TOP)


def scope_violation(spark, sf_dir):
    """Share of hits outside the query's label."""
    hits = search.dense_topk(_queries(spark, sf_dir), _nodes(spark, sf_dir), TOP)
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") != F.col("query_label")).cast("double")), 6).alias("violation_rate"))


def overlap_jaccard(spark, sf_dir):
    dense, same = (x.groupBy("query_id").agg(F.collect_list("node_id").alias(n)) for x, n in zip(_two_lists(spark, sf_dir), ("a", "b"), strict=True))
    parts = evaluation.overlap(F.col("a"), F.col("b"))
    return dense.join(same, "query_id").select("query_id", *[v.alias(k) for k, v in parts.items()])


def rank_delta(spark, sf_dir):
    """Ranks before (label order) and after (cosine) fusion side by side."""
    dense, same = _two_lists(spark, sf_dir)
    before = same.select("query_id", "node_id", F.col("rank").alias("pre_rank"))
    after = dense.select("query_id", "node_id", F.col("rank").alias("post_rank"))
    joined = before.join(after, ["query_id", "node_id"], "full_outer")
    return joined.withColumn("change", F.coalesce((F.col("pre_rank") - F.col("post_rank")).cast("string"), F.lit("dropped_or_new")))


QUERIES = {
    "dense_topk": dense_topk, "dense_filtered": dense_filtered, "bm25_topk": bm25_topk, "bm25_enriched": bm25_enriched, "fts_all_terms": fts_all_terms,
    "rrf_fusion": rrf_fusion, "hybrid_search": hybrid_search, "filing_aware_limit": filing_aware_limit, "strict_backfill": strict_backfill,
    "rank_metrics": rank_metrics, "scope_violation": scope_violation, "overlap_jaccard": overlap_jaccard, "rank_delta": rank_delta,
}

ORACLES = {
    "dense_topk": f"WITH {_VECTORS} SELECT query_id, node_id, rank, score FROM dense WHERE rank <= 10",
    "dense_filtered": f"WITH {_VECTORS}, f AS (SELECT query_id, node_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored WHERE label IN (0, 1, 2)) SELECT * FROM f WHERE rank <= 10",
    "bm25_topk": f"WITH {_bm25_cte('text')} SELECT query_id, node_id, score, rank FROM sparse WHERE rank <= 10",
    "bm25_enriched": f"WITH {_bm25_cte("left(source || chr(10) || source || chr(10) || text, 65000)")} SELECT query_id, node_id, score, rank FROM sparse WHERE rank <= 10",
    "fts_all_terms": f"""WITH {_bm25_cte('text')}, sizes AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id),
      hit AS (SELECT query_id, node_id, score FROM sparse_scored JOIN sizes USING (query_id) WHERE matched = n_terms)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM hit""",
    "rrf_fusion": f"""WITH {_LISTS}, lists AS (SELECT query_id, node_id, rank FROM dense WHERE rank <= 30 UNION ALL SELECT query_id, node_id, rank FROM same WHERE rank <= 30)
      SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score FROM lists GROUP BY ALL""",
    "hybrid_search": f"""WITH {_VECTORS}, {_bm25_cte('text')},
      lists AS (SELECT query_id, node_id, rank, 0 AS list_no FROM dense WHERE rank <= 30 AND query_id IN (SELECT query_id FROM asked)
               UNION ALL SELECT query_id, node_id, rank, 1 FROM sparse WHERE rank <= 30),
      f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score, min(list_no * 1000000 + rank) AS seen FROM lists GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, seen, node_id) AS r FROM f),
      s AS (SELECT o.*, d.source, row_number() OVER (PARTITION BY query_id, d.source ORDER BY r) AS place FROM o JOIN documents d ON d.doc_id = node_id WHERE r <= 40),
      p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 2 THEN 1 WHEN place <= 4 THEN 2 ELSE 3 END, r) AS rank FROM s)
      SELECT query_id, node_id, source, fusion_score, rank FROM p WHERE rank <= 10""",
    "filing_aware_limit": """WITH r AS (SELECT lang, source, doc_id AS node_id, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC NULLS LAST, doc_id) AS r FROM documents),
      s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY r) AS place FROM r),
      p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN place <= 1 THEN 1 WHEN place <= 2 THEN 2 ELSE 3 END, r) AS rank FROM s)
      SELECT lang, node_id, source, rank FROM p WHERE rank <= 30""",
    "strict_backfill": """WITH h AS (SELECT lang, d.doc_id AS node_id, length(text) AS score, coalesce(quality = 1, false) AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY matched DESC, score DESC NULLS LAST, node_id) AS rank FROM h)
      SELECT lang, node_id, matched, score, rank FROM r WHERE rank <= 20""",
    "rank_metrics": f"""WITH {_VECTORS}, g AS (SELECT query_id, count(*) AS n FROM embeddings JOIN q ON label = query_label GROUP BY query_id),
      h AS (SELECT query_id, count(*) FILTER (WHERE label = query_label) AS found, min(rank) FILTER (WHERE label = query_label) AS first_rank FROM dense WHERE rank <= 10 GROUP BY query_id)
      SELECT query_id, CAST(found > 0 AS INTEGER) AS hit, round(found / n, 6) AS gold_recall, round(coalesce(1 / first_rank, 0), 6) AS mrr FROM g JOIN h USING (query_id)""",
    "scope_violation": f"WITH {_VECTORS} SELECT query_id, round(avg(CASE WHEN label <> query_label THEN 1.0 ELSE 0.0 END), 6) AS violation_rate FROM dense WHERE rank <= 10 GROUP BY query_id",
    "overlap_jaccard": f"""WITH {_LISTS}, a AS (SELECT query_id, list(node_id) AS a FROM dense WHERE rank <= 30 GROUP BY query_id), b AS (SELECT query_id, list(node_id) AS b FROM same WHERE rank <= 30 GROUP BY query_id),
      n AS (SELECT query_id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_either FROM a JOIN b USING (query_id))
      SELECT query_id, n_both, n_either, round(n_both / n_either, 4) AS jaccard FROM n""",
    "rank_delta": f"""WITH {_LISTS} SELECT query_id, node_id, s.rank AS pre_rank, d.rank AS post_rank, coalesce(CAST(s.rank - d.rank AS VARCHAR), 'dropped_or_new') AS change
      FROM (SELECT query_id, node_id, rank FROM same WHERE rank <= 30) s FULL JOIN (SELECT query_id, node_id, rank FROM dense WHERE rank <= 30) d USING (query_id, node_id)""",
}
