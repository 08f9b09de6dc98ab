import pytest
from pyspark.sql import functions as F

from lodestone.operators import fact_nodes, filters, model_plans


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, 0, "p-1", {"domain": ["finance"], "finance_accns": ["0001", "7"]}), (9, 2, "p-2", {"domain": ['say "hi"']}), (9, 0, "p-1", None), (7, 1, None, {"domain": None}), (None, 0, "p-1", {})]
    return spark.createDataFrame(rows, "document_id long, level long, parent_id string, fields map<string,array<string>>")


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ({"document_ids": [9, 1]}, [(1, 0), (9, 0), (9, 2)]),
        ({"document_ids": [9, 1], "levels": [2, 0, 2], "parent_ids": ["p-1", " "], "metadata": {"domain": ["finance", "generic"], "finance_accns": ["0001"]}}, [(1, 0)]),
        ({"document_ids": ["abc", "9"], "metadata": {"domain": ['say "hi"', " "]}}, [(9, 2)]),
        ({"document_ids": ["nope", True, None]}, []),
        ({"document_ids": []}, []),
        ({"document_ids": [7], "metadata": {"domain": ["x"]}}, []),
        ({"document_ids": [7], "metadata": {"domain": [" "], "other": None}}, [(7, 1)]),
    ],
)
def test_conditions(nodes, asked, want):
    assert sorted((r.document_id, r.level) for r in nodes.filter(filters.condition(**asked)).collect()) == want


def test_plain_columns_reach_the_scan(spark, tmp_path, nodes):
    nodes.write.parquet(str(tmp_path / "nodes"))
    plan = spark.read.parquet(str(tmp_path / "nodes")).filter(filters.condition([9, 1], [0]))._jdf.queryExecution().executedPlan().toString()
    assert "In(document_id, [1,9])" in plan and "EqualTo(level,0)" in plan


def test_stages_keep_their_own_keys():
    asked = {"finance_accns": ["a", " a", "b"], "finance_form_base": "10-K", "finance_metric_exact_keys": ["x"], "domain": ["y"], "finance_period": [" "]}
    assert filters.staged_metadata(asked, "summary") == {"finance_accns": ["a", "b"], "finance_form_base": ["10-K"], "finance_metric_exact_keys": ["x"]}
    assert filters.staged_metadata(asked, "summary", narrative=True) == {"finance_accns": ["a", "b"], "finance_form_base": ["10-K"]}
    assert filters.staged_metadata(asked, "leaf", narrative=True, any_filing=True) == {"finance_form_base": ["10-K"]}


def test_books_chapters_and_sets(spark):
    documents = spark.createDataFrame([(1, "Apache Flink"), (2, "Apache Flink"), (3, "PEFT"), (4, None)], "document_id long, book_id string")
    sets = spark.createDataFrame([("s1", "enumerated", None, None, None, ["a", "b"]), ("s2", "filter", ["PEFT"], None, None, None), ("s3", "enumerated", None, None, None, None)], "set_id string, kind string, books array<string>, chapters array<long>, kinds array<string>, chunk_ids array<string>")
    rows = [
        (1, ["Apache Flink"], [3], None, None), (2, None, None, ["Image", " "], None), (3, None, None, ["video"], None), (4, ["不存在的书"], None, None, None), (5, None, [999], None, None),
        (6, ["PEFT"], None, None, "s1"), (7, None, None, None, "s1"), (8, [], None, None, "s2"), (9, None, None, None, "s9"), (10, ["PEFT", " PEFT ", "zz"], [3, 999, None], ["text"], None), (11, None, None, None, None), (12, None, None, None, "s3"),
    ]
    asked = spark.createDataFrame(rows, "filter_id long, books array<string>, chapters array<long>, kinds array<string>, set_id string")
    held = filters.resolved(asked, documents, sets)
    found = {r.filter_id: r for r in held.collect()}
    seen = {i: (r.document_ids, r.kinds, r.chunk_ids, r.error) for i, r in found.items()}
    assert seen == {
        1: ([1, 2, 3], None, None, None), 2: (None, ["image"], None, None), 3: (None, None, None, "unknown kinds: video"), 4: (None, None, None, "no documents"), 5: (None, None, None, "no documents"),
        6: (None, None, None, "filters and a set"), 7: (None, None, ["a", "b"], None), 8: ([3], None, None, None), 9: (None, None, None, "unknown set"), 10: ([3], ["text"], None, None), 11: (None, None, None, None), 12: (None, None, [], None),
    }
    assert found[4].missing_books == ["不存在的书"] and found[5].missing_chapters == [999] and found[10].missing_books == ["zz"] and found[10].missing_chapters == [999]
    chunks = spark.createDataFrame([("a", 1, "text"), ("b", 9, "image"), ("c", 3, "text"), ("d", 3, "image"), ("e", None, None)], "chunk_id string, document_id long, kind string")
    assert sorted(map(tuple, filters.admitted(chunks, held).collect())) == [(1, "a"), (1, "c"), (1, "d"), (7, "a"), (7, "b"), (8, "c"), (8, "d"), (10, "c")]


def test_plans_of_odd_answers(spark):
    rows = [(1, None), (2, ""), (3, "{}"), (4, '{"compare_mode": "latest", "prefer_recent": 0, "form_filters": [], "period_years": [1.5, "1995", null, 1995], "extra": {"deep": [1]}}'), (5, "text {not json} text")]
    found = {r.id: r for r in model_plans.checked(spark.createDataFrame(rows, "id long, answer string")).collect()}
    assert all(found[i].plan is None and found[i].faults == ["no object"] for i in (1, 2, 5))
    assert found[3].plan.compare_mode == "generic" and found[3].plan.prefer_recent is True and found[3].plan.form_filters is None
    assert found[3].faults == [f"{n}: missing" for n in ("metric_sql_hints", "metric_exact_keys", "period_end_dates", "period_years", "compare_mode", "prefer_recent")]
    assert found[4].plan.compare_mode == "latest" and found[4].plan.period_years == [1995] and found[4].plan.prefer_recent is True
    assert "period_years: dropped 3" in found[4].faults and "prefer_recent: not a truth value" in found[4].faults


FACT = "document_id long, taxonomy string, metric_key string, metric_label string, unit string, value_numeric double, value_text string, period_end string, filed_date string, form string, fy int, fp string, accn string"


def test_facts_come_in_batches_with_their_lists(spark):
    rows = [(1, "us-gaap", f"m{i % 30}", f"L\n{i}", "USD", float(i) if i % 2 else None, "text" if i % 4 == 0 else None, f"20{10 + i % 15}-12-31" if i % 5 else None, None, "10-K" if i % 3 else " ", 2020, "FY", f"a{i % 27}") for i in range(150)]
    rows += [(2, None, None, None, None, None, None, "bad", None, None, None, None, None)]
    facts = spark.createDataFrame(rows, FACT).repartition(7).withColumn("at", F.coalesce(F.regexp_extract("metric_label", "[0-9]+", 0).try_cast("int"), F.lit(0)))
    placed = fact_nodes.numbered(facts, "document_id", ["at"])
    assert {(r.document_id, r.at): r.position for r in placed.collect()} == {(1, i): i for i in range(150)} | {(2, 0): 0}
    documents = spark.createDataFrame([(1, 10, "One"), (2, None, None), (3, 30, "Three")], "document_id long, cik long, entity_name string")
    found = {r.node_id: r for r in fact_nodes.nodes(placed, documents).collect()}
    assert sorted(found) == ["f1", "f1.0", "f1.1", "f1.2", "f2", "f2.0", "f3", "f3.0"]
    assert found["f1"].text.startswith("SEC EDGAR company facts (XBRL): One | CIK 10 | 150 observations.") and "|  | CIK" not in found["f3"].text
    first = found["f1.0"]
    assert first.text.split("\n")[0] == "us-gaap.m0 | L 0 | unit=USD | val=text | end=None | filed=None | form=  | fy=2020 fp=FY | accn=a0"
    assert len(first.text.split("\n")) == 64 and first.title == "SEC facts 1/3"
    assert first.metric_keys == [f"m{i}" for i in range(24)] and first.forms == ["10-K"] and len(first.accns) == 24
    assert first.period_years == list(dict.fromkeys(f"20{10 + i % 15}" for i in range(64) if i % 5))[:12]
    assert found["f2.0"].period_years == [] and found["f2.0"].period_end_dates == ["bad"] and found["f2.0"].text.startswith("None.None |  | unit=None | val= |")
    assert found["f3.0"].text == "(no observations in facts payload)"


def test_positions_of_a_key_of_many_ranges(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 2 == 0, F.col("id")).alias("key"), (F.col("id") * 7919 % 6000).alias("at"))
    wanted = {}
    for key, at in sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        wanted.setdefault(key, []).append(at)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = fact_nodes.numbered(rows, "key", ["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.key, r.at): r.position for r in placed.collect()} == {(key, at): i for key, own in wanted.items() for i, at in enumerate(own)}
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_counts_are_those_of_the_pairs(spark):
    documents = spark.createDataFrame([(i, f"b{i % 4}") for i in range(40)] + [(1, "b9"), (50, None)], "document_id long, book_id string")
    sets = spark.createDataFrame([("s1", "enumerated", None, None, None, ["c1", "c50", "zz"]), ("s2", "filter", ["b9"], [2], ["image"], None)], "set_id string, kind string, books array<string>, chapters array<long>, kinds array<string>, chunk_ids array<string>")
    rows = [(i, [f"b{i % 6}", "b9"] if i % 3 else None, [i % 50, 50] if i % 4 == 1 else None, [["text"], ["image", "Text"], None][i % 3], None) for i in range(60)] + [(100, None, None, None, "s1"), (101, None, None, None, "s2"), (102, None, None, None, "s1")]
    asked = spark.createDataFrame(rows, "filter_id long, books array<string>, chapters array<long>, kinds array<string>, set_id string")
    chunks = spark.createDataFrame([(f"c{i}", i, k) for i in range(52) for k in ("text", "image", None)] + [("c1", 7, "text"), ("d", 3, "text")], "chunk_id string, document_id long, kind string")
    pairs = filters.admitted(chunks, filters.resolved(asked, documents, sets)).groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))
    found = filters.admitted_counts(chunks, documents, filters.judged(asked, documents, sets))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect())) and found.count() > 40


def test_documents_of_equal_filters_are_written_once(spark):
    documents = spark.createDataFrame([(i, f"b{i % 4}") for i in range(40)], "document_id long, book_id string")
    sets = spark.createDataFrame([], "set_id string, kind string, books array<string>, chapters array<long>, kinds array<string>, chunk_ids array<string>")
    asked = spark.createDataFrame([(i, [f"b{i % 2}", "zz"], [i + 1000], None, None) for i in range(50)], "filter_id long, books array<string>, chapters array<long>, kinds array<string>, set_id string")
    assert filters.document_sets(filters.judged(asked, documents, sets), documents).count() == 2
