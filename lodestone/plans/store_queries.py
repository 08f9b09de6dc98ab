"""Queries over tables that are written, changed and searched in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import postings, search, writes
from lodestone.session import shared_folder, table


def _place(spark):
    return f"{shared_folder(spark)}/lodestone/{uuid.uuid4().hex}"


def index_search(spark, sf_dir):
    """BM25 from an index that was built of all documents, then given new texts of one in ten and told that one in seventeen is gone."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text", F.lit(True).alias("live"))
    index = postings.Index(spark, _place(spark), "long")
    index.write(docs, 0)
    index.write(docs.filter("node_id % 10 = 3").withColumn("text", F.concat("text", F.lit(" revised the revised"))), 1)
    index.write(docs.filter("node_id % 17 = 5").withColumn("live", F.lit(False)), 2)
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" revised")).alias("query"))
    return search.ranked(index.search(asked), "score", "node_id", ["query_id"], 20)


def documents_replaced(spark, sf_dir):
    """Lines of orders: every seventh order gets one line for its old ones, every eleventh is flagged, every thirteenth loses all."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.lit(False).alias("flagged"))
    stored = writes.Table(spark, _place(spark), "l_orderkey")
    stored.create(lines)
    orders = lines.select("l_orderkey").distinct()
    sums = lines.filter("l_orderkey % 7 = 0").groupBy("l_orderkey").agg(F.sum("quantity").alias("quantity"))
    stored.replace(sums.select("l_orderkey", F.lit(0).cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"), "quantity", F.lit(False).alias("flagged")))
    stored.flag(orders.filter("l_orderkey % 11 = 0"), "flagged", F.lit(True))
    stored.replace(lines.limit(0), orders.filter("l_orderkey % 13 = 0"))
    return stored.rows().select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "quantity", "flagged")


def cascade_deleted(spark, sf_dir):
    """Orders of every ninth customer deleted from lines and orders, then from customers; what each table is left with."""
    kept = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"}
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("document_id"))
    rows = {
        "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"),
        "orders": owner, "customer": table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("document_id")),
    }
    place, tables = _place(spark), {}
    for name in kept:
        tables[name] = writes.Table(spark, f"{place}/{name}", "document_id")
        tables[name].create(rows[name])
    writes.Cascade(spark, f"{place}/cascade", tables).delete(rows["customer"].filter("document_id % 9 = 0").select("document_id"))
    left = [tables[n].rows().agg(F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("keys"), F.min("document_id").alias("least")).select(F.lit(n).alias("name"), "n", "keys", F.col("least").cast("long").alias("least")) for n, k in kept.items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


QUERIES = {f.__name__: f for f in (index_search, documents_replaced, cascade_deleted)}
ORACLES = {
    "index_search": """WITH docs AS (SELECT doc_id AS node_id, CASE WHEN doc_id % 10 = 3 THEN text || ' revised the revised' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 5),
      words AS (SELECT node_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM docs), corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM words),
      asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text || ' revised'), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 100 = 0),
      tf AS (SELECT node_id, term, length, count(*) AS tf FROM (SELECT node_id, len(w) AS length, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), corpus GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 20""",
    "documents_replaced": """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey % 7 <> 0
        UNION ALL SELECT l_orderkey, 0, sum(CAST(l_quantity AS DOUBLE)) FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, quantity, l_orderkey % 11 = 0 AS flagged FROM r WHERE l_orderkey % 13 <> 0""",
    "cascade_deleted": """SELECT 'lineitem' AS name, count(*) AS n, count(DISTINCT l_orderkey) AS keys, min(o_custkey) AS least FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 9 <> 0
      UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), min(o_custkey) FROM orders WHERE o_custkey % 9 <> 0
      UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey), min(c_custkey) FROM customer WHERE c_custkey % 9 <> 0""",
}
