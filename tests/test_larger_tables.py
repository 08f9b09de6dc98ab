"""Queries on tables made to have what only larger ones have."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog
from tests.conftest import SF, multiset


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query agrees with its SQL where some tables are replaced."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        for table in ("customer", "lineitem", "nation", "orders", "part", "supplier"):
            if table not in tables:
                (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet{'/*.parquet' if table in tables else ''}'")
        got = multiset(catalog.QUERIES[name](spark, str(tmp_path)).toPandas())
        return len(got[1]) > 0 and got == multiset(con.execute(catalog.ORACLES[name]).df())

    return run


def test_orders_whose_keys_have_seven_digits_stay_apart(spark, agrees):
    rows = [(1_200_000 + i, 1, "1-URGENT" if i % 2 else "5-LOW", dt.date(1995, 1 + i // 10, 1 + i % 10)) for i in range(40)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date")
    assert agrees("filing_hypotheses", orders=orders)


def test_keys_of_long_texts_are_those_of_the_whole_text(spark):
    prose = "The Board met in 2020. it paid $1,200 in the first\nquarter of Q3.\nthe rest | was left. " * 3
    stamp = "Acme 5 Corp | Q3 2017 Form 10-Q | 15 b c | q1 form\n10-k | 7 "
    texts = [prose * 20, prose.replace("|", "x") * 20, "1 2. a " * 900, "   .\n x" * 700, stamp * 60, ("word " * 30 + stamp) * 9, "a" * 3000, ("9" * 50 + ". b") * 60, "\n" * 3000 + "x.\ny" * 900, prose, "", None]
    from lodestone.functions import narrative

    plain = F.lower(F.coalesce("text", F.lit("")))
    masks = ((r"[a-z][a-z0-9 .,&'/-]*\|\s*q[1-4][^|\n]*form\s+10-[kq]\s*\|\s*\d+", " "), *narrative.MASKS[1:])
    for pattern, new in masks:
        plain = F.regexp_replace(plain, pattern, new)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = rows.select("text", narrative.selector_key(F.col("text")).alias("got"), F.left(F.trim(plain), F.lit(1200)).alias("want")).collect()
    assert [r.text for r in found if r.got != r.want] == []


def test_scores_come_in_slices_and_lists_in_shares(spark, monkeypatch):
    from lodestone.operators import evidence, search

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(300)], "node_id long, vector array<double>")
    asked = rows.limit(40).select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    best = lambda: sorted(map(tuple, search.dense_topk(asked, rows, 3).select("query_id", "node_id", "score", "rank").collect()))
    whole = best()
    monkeypatch.setattr(search, "SCORES", 700)
    assert best() == whole and len(whole) == 120

    hits = spark.range(3000).select((F.col("id") % 3).alias("query_id"), (F.col("id") % 500).alias("node_id"), (F.col("id") * 7919 % 3001).alias("rank"))
    parts = [hits.filter("rank % 4 = 0"), hits.filter("rank % 4 <> 0")]
    union = lambda: sorted(map(tuple, evidence.priority_union(parts, 40).collect()))
    whole = union()
    monkeypatch.setattr(evidence, "ROWS_A_TASK", 100)
    assert union() == whole and len(whole) == 120
    assert evidence.priority_union(parts, 40).rdd.getNumPartitions() == 30


def test_postings_of_long_batches_come_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from lodestone.operators import postings

    monkeypatch.setattr(postings, "PART_BYTES", 100)
    batch = pa.record_batch([pa.array(range(50)), pa.array(["ab cd " * (i % 9) for i in range(49)] + [None])], names=["node_id", "low"])
    parts = list(postings._parts(batch))
    assert len(parts) > 5 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in postings._parts(batch.slice(0, 0))] == [0]


@pytest.mark.parametrize("n", [1, 2, 5, 16])
def test_runs_are_the_same_held_or_joined(spark, monkeypatch, n):
    from lodestone.operators import evaluation

    words = ["alpha", "be ta", "gam\tma", "délta", "𝒳y", "o"]
    texts = ["".join(words[(i * 7 + j * j) % 6] for j in range(i)) for i in range(30)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    asked = rows.filter("text_id % 5 = 4").withColumnRenamed("text_id", "question_id")
    runs = lambda: sorted(map(tuple, evaluation.copied_runs(asked, rows, n).collect()))
    held = runs()
    monkeypatch.setattr(evaluation, "BROADCAST_WINDOWS", 0)
    assert runs() == held and len(held) > 20
