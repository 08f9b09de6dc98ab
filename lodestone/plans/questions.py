"""Questions made from orders, for the queries that read questions, and the SQL that makes the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.session import table

STARTS = ("What was the net income of", "Compare gross margin and cost of revenue of", "List the risk factors filed for", "How did liquidity develop in", "Name the latest EPS of", "Revenue year over year in", "Did sales fall quarter over quarter in", "Is there substantial doubt in", "NetIncomeLoss by segment in", "Sum up the management discussion of", "Assets as of 2019-12-31 and", "Operating income under ASU 2016 and Item", "Hello from", "GrossProfitRatio2 and Consolidated results of operations in", "净利润 of")
ENDS = ("", "in the 10-K", "from a 10-Q", "as in the 8-K/A", "by annual report", "quarterly", "fy 2021", "and the trend", "for q2", "年报", "10.K / A", "the most recent 10K", "2011 2012 2013 2014 2015 2016 2017")


def asked_of_orders(spark, sf_dir):
    """(query_id, question): a start, the order's year moved by ten, and an end."""
    pick = lambda words, c: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(c) % len(words) + 1).cast("int"))
    text = F.concat_ws(" ", pick(STARTS, "o_orderkey"), (F.year("o_orderdate") + 10).cast("string"), pick(ENDS, "o_custkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), text.alias("question"))


_picked = lambda words, c: f"([{', '.join(repr(w) for w in words)}])[{c} % {len(words)} + 1]"
ASKED_SQL = f"""w AS (SELECT o_orderkey AS query_id, {_picked(STARTS, "o_orderkey")} || ' ' || (year(o_orderdate) + 10) || ' ' || {_picked(ENDS, "o_custkey")} AS t FROM orders),
      q AS (SELECT *, CASE WHEN contains(lower(t), 'year over year') THEN 'yoy' WHEN contains(lower(t), 'quarter over quarter') THEN 'qoq' WHEN regexp_matches(lower(t), '\\b(latest|most recent|newest)\\b') THEN 'latest' WHEN contains(t, '2019-12-31') THEN 'point_in_time' ELSE 'generic' END AS compares FROM w)"""
