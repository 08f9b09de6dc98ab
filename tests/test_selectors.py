from pyspark.sql import functions as F

from lodestone.operators import selectors


def test_greedy_near_duplicates_fill_up_last(spark):
    rows = [("q", 1, "p", "the quick brown fox", 1), ("q", 2, "r", "the quick brown fix", 2), ("q", 3, "p", "else", 3), ("q", 4, None, "other words", 4), ("q", 5, None, None, 5)]
    hits = spark.createDataFrame(rows, "query_id string, node_id long, parent_id string, text string, rank long")
    found = selectors.without_near_duplicates(hits, 4).orderBy("chosen").collect()
    assert [(r.node_id, r.duplicate) for r in found] == [(1, False), (4, False), (5, False), (2, True)]


def test_quota_replaces_the_lowest_unwanted(spark):
    hits = spark.createDataFrame([("q", i, i, i in (2, 5, 6)) for i in range(1, 7)], "query_id string, node_id long, rank long, wanted boolean")
    assert [r.node_id for r in selectors.with_quota(hits, 4, 2).orderBy("chosen").collect()] == [1, 2, 3, 5]


def test_bucket_caps_give_way_in_the_last_pass(spark):
    rows = [("q", 1, 1, "a", "x"), ("q", 2, 2, "b", "x"), ("q", 3, 3, "a", "y"), ("q", 4, 4, "c", "y"), ("q", 5, 5, "a", "z")]
    hits = spark.createDataFrame(rows, "query_id string, node_id long, rank long, source string, bucket string")
    assert [r.node_id for r in selectors.capped(hits, 4, 1, {"x": 1}).orderBy("chosen").collect()] == [1, 4, 3, 2]


def test_budget_skips_mandatory_rows_and_stops_at_others(spark):
    rows = [("q", 1, 1, "x" * 4, False), ("q", 2, 2, "x" * 20, True), ("q", 3, 3, "x" * 3, True), ("q", 4, 4, "x" * 9, False), ("q", 5, 5, "x", False), ("r", 1, 1, "x" * 99, False)]
    hits = spark.createDataFrame(rows, "query_id string, node_id long, rank long, text string, mandatory boolean")
    found = selectors.context_by_budget(hits, 9, 10).orderBy("query_id", "chosen").collect()
    assert [(r.query_id, r.node_id) for r in found] == [("q", 3), ("q", 1), ("r", 1)]


def test_quotes(spark):
    row = spark.createDataFrame([("a\nb ", "x a\r\nb y", "no")], "q string, e string, n string").select(selectors.verbatim(F.col("q"), F.col("e")).alias("v"), selectors.verbatim(F.col("n"), F.col("e")).alias("w"), selectors.confidence(F.lit(20), F.lit(True)).alias("c")).first()
    assert (row.v, row.w, row.c) == ("a\nb", None, 0.95)
