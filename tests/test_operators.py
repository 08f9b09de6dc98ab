from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import chunking
from lodestone.functions import text as T
from lodestone.operators import evaluation, facts, planning, search, tables, trees
from lodestone.sources import companyfacts
from lodestone.sources.html import visible
from lodestone.streaming import windows


def ranks(spark, *lists):
    return [spark.createDataFrame([("q", n, i) for i, n in enumerate(x, 1)], "query_id string, node_id string, rank long") for x in lists]


def test_rrf_scores(spark):
    rows = {r.node_id: r.fusion_score for r in search.rrf(ranks(spark, ["a", "x"], ["b", "a", "c"])).collect()}
    assert rows == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 61, "x": 1 / 62, "c": 1 / 63})


def test_rrf_order_and_ties(spark):
    found = search.fused(ranks(spark, ["d", "x", "z"], ["d", "y", "z"]), 10).orderBy("rank").collect()
    assert [r.node_id for r in found] == ["d", "z", "x", "y"]
    assert search.fused(ranks(spark, ["b"], ["a"]), 1).first().node_id == "b"


def test_source_limit_goes_through_three_passes(spark):
    rows = spark.createDataFrame([("q", i, s, i) for i, s in enumerate("aaaaaab", 1)], "query_id string, node_id long, source string, rank long")
    found = search.source_limit(rows, 5, 1, ["query_id"]).orderBy("rank").collect()
    assert [r.node_id for r in found] == [1, 7, 2, 3, 4]


def test_evidence_score_takes_zero_as_missing(spark):
    row = spark.range(1).select(search.evidence_score(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.4)).alias("s"), search.evidence_score(F.lit(0.9), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("t")).first()
    assert (row.s, row.t) == (0.4, 0.9)


def test_budget_keeps_the_first_row(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 5), (2, 1, 3), (2, 2, 4), (2, 3, 9)], "g long, o long, size long")
    found = trees.within_budget(rows, ["g"], "o", F.col("size"), 10).select("g", "o").collect()
    assert {(r.g, r.o) for r in found} == {(1, 1), (2, 1), (2, 2)}


def test_section_tree_keeps_one_node_for_a_revisited_path(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], 0), (1, ["c"], 1), (1, ["a", "b"], 2), (1, ["a"], 3), (1, [], 4)], "d long, path array<string>, position long")
    found = trees.section_tree(rows, ["d"]).orderBy("order_index").collect()
    assert [("/".join(r.prefix), r.leaves) for r in found] == [("a", 3), ("a/b", 2), ("c", 1)]


def test_elements_at(spark):
    nan, inf = float("nan"), float("inf")
    values = {"a": list(range(10)), "b": [5.0] * 7, "c": [None, None], None: [1.0, None, 2.0, inf, -inf, nan], "d": [1e308, -1e308, 0.5, 0.25, 0.125], "e": [(i * 37 % 1009) ** 3 / 7 for i in range(1000)]}
    rows = spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in values.items() for v in vs], "k string, x double")
    places = {"p": evaluation.floor_place(F.col("n"), 0.95), "q": evaluation.bankers_place(F.col("n"), 50)}
    for bins in (1, 3, 4096):
        got = {r.k: (repr(r.p), repr(r.q)) for r in evaluation.elements_at(rows, ["k"], "x", places, bins).collect()}
        want = {}
        for k, vs in values.items():
            held = sorted((float(v) for v in vs if v is not None), key=lambda v: (v != v, v))
            if held:
                want[k] = (repr(held[int(0.95 * (len(held) - 1))]), repr(held[round(0.5 * (len(held) - 1))]))
        assert got == want
    assert evaluation.elements_at(rows.limit(0), ["k"], "x", places).count() == 0
    assert evaluation.elements_at(rows.filter("k = 'a'"), [], "x", places).collect() == [(8.0, 4.0)]


def test_gate_directions(spark):
    now = spark.createDataFrame([("hit", True, 0.95), ("violation", False, 0.2), ("mrr", True, 1.0), ("new", True, 1.0)], "metric string, higher_better boolean, value double")
    then = spark.createDataFrame([("hit", True, 1.0), ("violation", False, 0.1), ("mrr", True, 1.01)], "metric string, higher_better boolean, value double")
    assert {r.metric: r.regression for r in evaluation.gate(now, then, 0.02).collect()} == {"hit": True, "violation": True, "mrr": False, "new": False}


def test_first_mode_breaks_ties_by_first_seen(spark):
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "k string, v string, p long")
    assert evaluation.first_mode(rows, ["k"], "v", "p").first().mode == "b"


def test_companyfacts(spark):
    payload = '{"cik": 7, "entityName": "E", "facts": {"us-gaap": {"Rev": {"label": "L", "units": {"USD": [{"val": "1,200", "end": "2024-03-31", "filed": "bad", "fy": 2024, "fp": "q1", "accn": "0-24-1"}, {"val": true}, {"val": " text "}, {"val": 2.5}, {"val": "nan"}, {"val": "1_000"}]}}}}}'
    rows = companyfacts.flatten(spark.createDataFrame([(1, payload), (2, "{}"), (3, None)], "document_id long, payload string")).orderBy("pos").collect()
    assert [(r.value_numeric, r.value_text) for r in rows] == [(1200.0, None), (None, None), (None, "text"), (2.5, None), (None, "nan"), (None, "1_000")]
    assert rows[0].period_end == dt.date(2024, 3, 31) and rows[0].filed_date is None and rows[0].fp == "Q1"


def test_accession_periods_prefer_statements_then_modes(spark):
    schema = "accn string, pos long, fy int, fp string, end string, concept string, value string"
    rows = [("a", 1, 2023, "Q1", "2023-03-31", "Rev", "1"), ("a", 2, 2024, "Q1", "2024-03-31", "Rev", "1"), ("a", 3, 2023, "Q2", "2023-06-30", "Rev", "2"), ("a", 4, None, None, None, "DocumentFiscalPeriodFocus", "q3"), ("b", 1, 2022, "FY", "2022-12-31", "Rev", "1")]
    found = {r.accn: (r.fy, r.fp, r.period_end, r.source) for r in facts.accession_periods(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": (2023, "Q3", "2023-03-31", "mode"), "b": (2022, "FY", "2022-12-31", "mode")}


def test_staged_stops_when_enough(spark):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "k long")
    assert [(r.k, r.stage) for r in facts.staged([frame([1, 2]), frame([2, 3, 4]), frame([9])], ["k"], 3, ["k"]).collect()] == [(1, 0), (2, 0), (3, 1)]


def test_text_functions(spark):
    row = spark.createDataFrame([("What drove NetIncomeLoss in 2024 vs 2023-12-31, year over year?", "  a \r\n\r\n b", "10.K/A")], "q string, t string, f string").select(
        T.metric_hints(F.col("q")).alias("hints"), T.period_dates(F.col("q")).alias("dates"), T.compare_mode(F.col("q")).alias("mode"), T.clean_lines(F.col("t")).alias("clean"),
        T.form_base(F.col("f")).alias("form"), T.enriched(F.lit("T"), F.lit(" "), F.lit("body")).alias("rich"), T.preview(F.lit("abcdefgh"), 6).alias("cut"), T.padded_cik(F.lit("CIK 12")).alias("cik"), T.accession_year(F.lit("0001-31-02")).alias("year"),
    ).first()
    assert row.hints == ["NetIncomeLoss"] and row.dates == ["2023-12-31"] and row.mode == "yoy"
    assert (row.clean, row.form, row.rich, row.cut, row.cik, row.year) == ("a\nb", "10-K", "T\nT\nbody", "abc...", "0000000012", 1931)


def test_plan(spark):
    questions = spark.createDataFrame([(1, "Why did revenue fall in the 2023 annual report?"), (2, "NetIncomeLoss 10-Q 2020"), (3, None), (4, "gross margin 2021 vs 2022"), (5, "风险因素 and the 2022年 outlook"), (6, "Assets as of 2022-06-30"), (7, "eps 10.K/A")], "query_id long, question string")
    plans = {r.query_id: r for r in planning.plan(questions).collect()}
    assert [plans[i].mode for i in range(1, 8)] == ["mixed_facts_first", "mixed_facts_first", "facts_only", "cross_filing_compare", "mixed_narrative_first", "mixed_facts_first", "mixed_facts_first"]
    assert (plans[1].forms, plans[1].metrics[0], plans[1].period_years, plans[1].budget.sql_rows) == (["10-K"], "Revenues", ["2023"], 56)
    assert plans[2].retrieval_query == "NetIncomeLoss 10-Q 2020\n\nXBRL metrics: NetIncomeLoss" and plans[2].forms == ["10-Q"]
    assert (plans[3].retrieval_query, plans[3].terms, plans[3].budget.sql_rows) == ("", [], 80)
    assert (plans[4].targets, plans[4].needs.cross_filing) == (["margin_cost_structure"], True)
    assert plans[5].period_years == [] and plans[5].targets == ["risk_factors"] and "Item 1A" in plans[5].narrative_query
    assert (plans[6].compare_mode, plans[6].prefer_recent, plans[7].forms) == ("point_in_time", True, ["10-K/A", "10-K"])
    kinds = planning.plan(spark.createDataFrame([("x", "numeric"), ("x", "narrative"), ("x vs y", "numeric")], "question string, kind string"), kind="kind")
    assert [r.mode for r in kinds.collect()] == ["facts_only", "narrative_only", "cross_filing_compare"]


def test_listed_metrics(spark):
    row = spark.range(1).select(planning.listed_metrics(F.array(*[F.lit(x) for x in ("us-gaap.Revenues", " Revenues ", "Other", "", "Cash")])).alias("m")).first()
    assert row.m == ["Revenues", "Cash"]


def test_scope_and_narrowing(spark):
    asked = {1: "Revenue of FY2023?", 2: "ASU 2014-15 and the 10-Ks", 3: None, 4: "quarterly reports of 2022, risk factors", 5: "in 1999", 6: "Item 2024 of 2025"}
    scopes = spark.createDataFrame(list(asked.items()), "query_id long, question string").select("query_id", planning.scope(F.col("question")).alias("s")).select("query_id", "s.*")
    got = {r.query_id: (r.periods, r.forms, r.sections, r.explicit) for r in scopes.collect()}
    assert got[1] == (["2023"], [], [], True) and got[2] == ([], ["10-K"], [], True) and got[3] == ([], [], [], False)
    assert got[4] == (["2022"], ["10-Q"], ["risk_factors"], True) and got[5] == ([], [], [], False) and got[6] == (["2025"], [], [], True)
    documents = spark.createDataFrame([(7, ["2023", "2022"], ["10-K"]), (8, ["2022"], ["10-Q"]), (9, None, None)], "document_id long, years array<string>, forms array<string>")
    assert {tuple(r) for r in planning.narrowed(documents, scopes).collect()} == {(1, 7), (2, 7), (3, None), (4, 8), (5, None), (6, None)}


def test_visible_text():
    html = "<h2>T</h2><style>x</style><p>a <b>b</b></p><table><tr><th>k</th><td>1</td></tr></table>tail"
    assert visible(html) == "## T\na b\nTABLE | k | 1\ntail"
    assert visible(None) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. !?\n", max_size=400), st.integers(20, 60))
def test_pieces_never_exceed_the_limit(text, limit):
    found = chunking.pieces(text, limit, 8)
    assert all(len(p) <= limit for p in found)
    assert not text.strip() or found


def test_chunks_follow_headings():
    found = chunking.chunks("# A\n\none\n\n## B\n\ntwo\n\nthree\n\n# C\n\nfour")
    assert [(c["path"], c["text"]) for c in found] == [(["A"], "one"), (["A", "B"], "two\n\nthree"), (["C"], "four")]


def test_tables(spark):
    current = spark.createDataFrame([(1, "a", {"x": "1", "y": "1"}), (2, "b", None)], "id long, title string, metadata map<string,string>")
    changes = spark.createDataFrame([(1, None, {"y": "2"}), (3, "c", {"z": "1"})], "id long, title string, metadata map<string,string>")
    assert {r.id: (r.title, r.metadata) for r in tables.upserted(current, changes, "id").collect()} == {1: ("a", {"x": "1", "y": "2"}), 2: ("b", {}), 3: ("c", {"z": "1"})}
    ids = spark.createDataFrame([(1,), (9,)], "id long")
    left, gone, missing = tables.deleted(current, ids, "id")
    assert [r.id for r in left.collect()] == [2] and [r.id for r in gone.collect()] == [1] and [r.id for r in missing.collect()] == [9]
    assert tables.next_id(current, spark.createDataFrame([(3,), (4,), (6,)], "id long"), "id") == 5
    assert tables.parsed_ids("9801, 9805-9807,") == [9801, 9805, 9806, 9807]
    jobs = spark.createDataFrame([(None, None, {"a": 1.0, "b": float("nan")}, {"a": "0"})], "error string, skipped_reason string, scores map<string,double>, metadata map<string,string>")
    assert (tables.completed(jobs).first().status, tables.completed(jobs).first().metadata) == ("completed", {"a": "1.0"})


def test_streams_agree_with_batch(spark, tmp_path):
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    counts = windows.rate_counts(windows.read_tables(spark, str(tmp_path / "in"), events))
    query = counts.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == events.count()
    jobs = events.withColumn("status", F.when(F.col("event_type") == "view", "pending").otherwise("done"))
    jobs.write.parquet(str(tmp_path / "jobs"))
    windows.drain(windows.read_tables(spark, str(tmp_path / "jobs"), jobs), lambda rows: rows.select("event_id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == jobs.filter("status = 'pending'").count()
