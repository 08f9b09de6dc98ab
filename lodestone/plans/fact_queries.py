"""Structured-facts queries; lineitem and orders play the long fact table and the filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import facts, trees
from lodestone.session import table


def facts_filter_latest(spark, sf_dir):
    rows = facts.observations(table(spark, sf_dir, "lineitem"), {"l_linestatus": "F"}, {"l_returnflag": ["A", "R"]}, [1994, 1995], "l_shipdate")
    return facts.newest(rows, ["l_shipdate", "l_orderkey", "l_linenumber"], 200).select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("period_end"), "l_returnflag")


def facts_hint_like(spark, sf_dir):
    rows = table(spark, sf_dir, "part").filter(facts.matches_hints(F.col("p_name"), F.col("p_type"), ["Standard", "Promo%Burnished", "short"]))
    return rows.select("p_partkey", "p_name", "p_type")


def facts_staged_fallback(spark, sf_dir):
    """Large returned lines of urgent orders, else all returned lines of that size, else the newest."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 480000").select(F.col("o_orderkey").alias("l_orderkey"))
    exact = rows.filter("l_returnflag = 'R' and l_quantity >= 49").join(urgent, "l_orderkey", "left_semi")
    return facts.staged([exact, rows.filter("l_returnflag = 'R' and l_quantity >= 50"), rows], ["l_orderkey", "l_linenumber"], 12, ["l_orderkey", "l_linenumber"])


def facts_rank_rows(spark, sf_dir):
    """Additive score: 4 for a preferred filing, 5 for the metric, 2 for the term, 0.5 for a number; the best 50."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [("o_orderpriority = '1-URGENT'", 4.0), ("l_returnflag = 'R'", 5.0), ("l_linestatus = 'F'", 2.0), ("l_extendedprice is not null", 0.5)]
    score = sum((F.when(F.expr(c), F.lit(v)).otherwise(0.0) for c, v in parts), F.lit(0.0))
    return joined.select("l_orderkey", "l_linenumber", score.alias("score")).orderBy(F.desc("score"), "l_orderkey", "l_linenumber").limit(50)


def catalog_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("nodes"))
    return table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("nodes", F.lit(0).cast("long")).alias("nodes"))


def filing_distribution(spark, sf_dir):
    return facts.filing_weights(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_discount") * 10)


def recency_bonus(spark, sf_dir):
    bonus = trees.recency_bonus(["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(bonus, 6).alias("bonus"))


def children_capped(spark, sf_dir):
    return trees.first_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], 3).select("l_orderkey", "l_linenumber", "l_partkey", "place")


def tree_descendants(spark, sf_dir):
    """Region -> nation -> customer."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = nation.select(node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child")).unionByName(customer.select(node("n", "c_nationkey").alias("parent"), node("c", "c_custkey").alias("child")))
    return trees.descendants(spark, edges, region.select(node("r", "r_regionkey").alias("root"))).filter("node like 'c%'").select("root", "node", F.col("depth").cast("long").alias("depth"))


def accession_alignment(spark, sf_dir):
    """Facts and filings side by side by key, only where both have rows; leftovers flagged."""
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("accn")).agg(F.count(F.lit(1)).alias("n_facts"))
    b = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("accn"), "o_orderpriority")
    joined = a.join(b, "accn", "full_outer")
    side = F.when(F.col("n_facts").isNull(), "passage").when(F.col("o_orderpriority").isNull(), "fact").otherwise("both")
    return joined.select("accn", side.alias("side"), F.coalesce("n_facts", F.lit(0).cast("long")).alias("n_facts"))


def metric_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


QUERIES = {f.__name__: f for f in (facts_filter_latest, facts_hint_like, facts_staged_fallback, facts_rank_rows, catalog_counts, filing_distribution, recency_bonus, children_capped, tree_descendants, accession_alignment, metric_summary)}
ORACLES = {
    "facts_filter_latest": "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS period_end, l_returnflag FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') AND year(l_shipdate) IN (1994, 1995) ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC LIMIT 200",
    "facts_hint_like": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'standard') OR contains(lower(p_type), 'standard') OR contains(lower(p_name), 'promoburnished') OR contains(lower(p_type), 'promoburnished')",
    "facts_staged_fallback": """WITH s AS (
        SELECT l.*, 0 AS stage FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 49 AND o_orderpriority = '1-URGENT' AND o_totalprice > 480000
        UNION ALL SELECT *, 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50 UNION ALL SELECT *, 2 FROM lineitem),
      o AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, min(stage) AS stage FROM s GROUP BY ALL),
      n AS (SELECT k, (SELECT count(*) FROM o p WHERE p.stage < t.k) AS before FROM (SELECT DISTINCT stage AS k FROM o) t)
      SELECT o.* FROM o JOIN n ON n.k = o.stage WHERE before < 12 ORDER BY stage, l_orderkey, l_linenumber LIMIT 12""",
    "facts_rank_rows": """SELECT l_orderkey, l_linenumber, (CASE WHEN o_orderpriority = '1-URGENT' THEN 4.0::DOUBLE ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 5.0::DOUBLE ELSE 0 END)
      + (CASE WHEN l_linestatus = 'F' THEN 2.0::DOUBLE ELSE 0 END) + (CASE WHEN l_extendedprice IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END) AS score
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 50""",
    "catalog_counts": "SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS nodes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "filing_distribution": "SELECT l_suppkey, round(sum(greatest(0.25::DOUBLE, l_discount * 10)), 4) AS weight, count(*) AS n FROM lineitem GROUP BY 1",
    "recency_bonus": "SELECT o_orderkey, round(0.18::DOUBLE * (1 - (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1) / greatest(1, count(*) OVER (PARTITION BY o_custkey) - 1)), 6) AS bonus FROM orders",
    "children_capped": "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 3",
    "tree_descendants": """WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
      below AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, child, depth + 1 FROM below JOIN edges ON parent = node)
      SELECT root, node, CAST(depth AS BIGINT) AS depth FROM below WHERE node LIKE 'c%'""",
    "accession_alignment": """SELECT coalesce(a.k, b.k) AS accn, CASE WHEN a.k IS NULL THEN 'passage' WHEN b.k IS NULL THEN 'fact' ELSE 'both' END AS side, coalesce(n, 0) AS n_facts
      FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k""",
    "metric_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL",
}
