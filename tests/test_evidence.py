import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, evidence, reports, sampling, tables
from lodestone.sources import layout, questions

FACT = "q string, id long, accn string, taxonomy string, metric_key string, metric_label string, form string, frame string, value_numeric double, value_text string, period_end string, filed_date string, position long"


def texts(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_ranked_facts(spark):
    fact = lambda i, accn, key, number: ("q", i, accn, "us-gaap", key, "Label", "10-K", None, number, None, "2020-12-31", None, i)
    rows = spark.createDataFrame([fact(1, "a", "us-gaap.Assets", 1.0), fact(2, "b", "Revenues", None), fact(3, "x", "Other", None), fact(4, "x", "Other", 2.0), fact(5, "x", "Other", 2.0)], FACT)
    got = evidence.ranked_facts(rows, texts("a"), texts("us-gaap.Revenues"), texts("nothing"), ["q"]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(2, 5.0), (1, 4.5), (5, 0.5), (4, 0.5)]
    none = F.lit(None).cast("array<string>")
    assert evidence.ranked_facts(rows.filter("id = 3"), none, none, none, ["q"]).count() == 1


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(
        [(1, "0000000001-20-000001", "10K", "2020-02-01", ["2019-12-31"], None), (1, "0000000001-20-000002", "10-Q/A", "2020-05-01", ["2020-03-31"], [2020]), (2, "0000000001-21-000001", "10-K", None, None, None)],
        "document_id long, accession string, form string, filed string, period_end_dates array<string>, period_years array<int>",
    )


def test_filing_years(catalog):
    got = {r.accession[-9:]: (r.form_base, r.candidate_years) for r in evidence.filing_years(catalog).collect()}
    assert got == {"20-000001": ("10-K", [2020, 2019]), "20-000002": ("10-Q", [2020]), "21-000001": ("10-K", [2021])}


def test_filing_hypotheses(spark, catalog):
    plans = spark.createDataFrame([("a", ["10-K"], [2019], None, "generic", False), ("b", None, None, None, None, None)], "query_id string, forms array<string>, years array<int>, dates array<string>, compare_mode string, prefer_recent boolean")
    scope = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "query_id string, document_id long")
    got = {(r.query_id, r["rank"]): (r.accession[-9:], r.weight) for r in evidence.filing_hypotheses(catalog, plans, scope).collect()}
    # form, year and the bonus of the second newest; form alone; no match at all
    assert got["a", 1] == ("20-000001", pytest.approx(0.02 + 0.34 + 0.22 + 0.08, abs=1e-4))
    assert got["a", 2] == ("21-000001", pytest.approx(0.02 + 0.34 - 0.18 + 0.0, abs=1e-4))
    assert got["a", 3][1] == 0.0
    assert got["b", 1] == ("20-000002", 0.1) and len(got) == 5


def test_filings_weighed(spark):
    hits = spark.createDataFrame([("q", ["a", "b"], 1.0, 1), ("q", ["a"], 0.0, 2)], "query_id string, accessions array<string>, score double, rank long")
    passages = evidence.hit_weights(hits)
    facts = spark.createDataFrame([("q", "c", 3.0), ("q", "document:1", 9.0), ("q", "b", 1.0)], "query_id string, filing string, weight double")
    assert {r.filing: r.weight for r in evidence.merged_weights([facts, passages]).collect()} == {"a": 1.01, "b": 2.0, "c": 3.0}
    plans = spark.createDataFrame([("q", "narrative_only", True, True)], "query_id string, mode string, need_narrative boolean, need_facts boolean")
    got = evidence.target_filings(facts, passages, plans, 3).orderBy("rank").collect()
    assert [(r.filing, r.primary) for r in got] == [("a", True), ("b", True), ("c", False)]
    assert evidence.second_pass(plans, facts.filter("filing = 'c'"), passages).first().reasons == ["filing_divergence"]
    assert evidence.second_pass(plans, facts.limit(0), passages).first().reasons == ["missing_structured"]
    assert evidence.second_pass(plans, facts.limit(0), passages.limit(0)).first().reasons == []
    keys = spark.range(1).select(evidence.filing_key(texts(" ", "x"), F.lit(1)).alias("a"), evidence.filing_key(texts(), F.lit(1)).alias("b")).first()
    assert tuple(keys) == ("x", "document:1")


def test_aligned_context(spark):
    schema = "query_id string, accn string, rank long, document_id long, taxonomy string, metric_key string, metric_label string, value_numeric double, value_text string, unit string, period_end string, filed_date string, form string, fy int, fp string"
    fact = lambda q, accn, rank: (q, accn, rank, 1, "us-gaap", "Assets", "", 1.0, None, "USD", "2020-12-31", None, "10-K", 2020, "FY")
    facts = spark.createDataFrame([fact("q", "b", 1), fact("q", "a", 2), fact("q", None, 3), fact("r", "a", 1)], schema)
    passages = spark.createDataFrame([("q", "a", 1, "one"), ("q", "a", 2, " "), ("q", "c", 3, "two"), ("q", None, 4, "three"), ("r", "z", 1, "x")], "query_id string, accn string, rank long, text string")
    got = evidence.aligned_context(facts, passages).collect()
    assert len(got) == 1
    heads = [part.split("\n")[0] for part in got[0].context.split("\n\n")]
    assert heads == ["== Filing b (10-K, period ending 2020-12-31) ==", "== Filing a (10-K, period ending 2020-12-31) ==", "== Filing c ==", "[Other structured facts]", "[Other retrieved passages]"]
    assert "[Narrative passages]\n  Passage 1: one\n[Structured XBRL facts]\n1. doc=1" in got[0].context


def test_hits_merged(spark):
    hits = spark.createDataFrame([("q", s, n, score) for s, n, score in ((0, "a", 0.9), (0, "b", 0.5), (1, "b", 0.7), (1, "c", None))], "query_id string, sub int, node_id string, score double")
    assert [(r.node_id, r.score) for r in evidence.merged_subqueries(hits, 2).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.7)]
    lists = [spark.createDataFrame([("q", n, i) for i, n in enumerate(x)], "query_id string, node_id string, rank long") for x in ("b", "ab", "c")]
    assert [r.node_id for r in evidence.priority_union(lists, 2).orderBy("rank").collect()] == ["b", "a"]
    scores = spark.createDataFrame([("q", "a", None, 2.0)], "query_id string, node_id string, x double, y double")
    rows = spark.createDataFrame([("q", "a", 1.0, 1.0), ("q", "b", 1.0, None)], "query_id string, node_id string, x double, y double")
    assert sorted(map(tuple, evidence.overlaid(rows, scores, ["x", "y"]).collect())) == [("q", "a", 1.0, 2.0), ("q", "b", 1.0, None)]
    tests = [evidence.touches(texts("a"), texts(), F.lit("Of Assets"), texts(*w), texts(*t)) for w, t in ((["a"], []), (["b"], []), ([], ["assets"]))]
    assert tuple(spark.range(1).select(*[t.alias(str(i)) for i, t in enumerate(tests)]).first()) == (True, False, True)


def test_best_sources(spark):
    leads = spark.createDataFrame([("q", 1, "Open, day!"), ("q", 2, "zzz")], "query_id string, lead_id long, text string")
    sources = spark.createDataFrame([("q", "u", "the open day is", 1.0), ("q", "v", "open doors", None), ("r", "w", "open day", 9.0)], "query_id string, url string, text string, quality double")
    got = evidence.best_sources(leads, sources).orderBy("rank").collect()
    assert [(r.lead_id, r.url) for r in got] == [(1, "u"), (1, "v")] and got[0].score == 1.05


def test_draws_agree_with_a_loop(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("abc"), rng.choice(["x", None])) for i in range(40)]
    rows = spark.createDataFrame(data, "id long, book string, kind string")
    order = {r.id: r.h for r in rows.select("id", sampling.shuffled(F.col("id"), 5).alias("h")).collect()}
    pools = {}
    for i, book, kind in sorted(data, key=lambda r: (order[r[0]], r[0])):
        pools.setdefault((book, kind), []).append(i)
    expected = []
    while len(expected) < 9:
        before = len(expected)
        for cell in sorted(pools, key=lambda c: (c[0], c[1] is not None, c[1] or "")):
            if len(expected) < 9 and len(pools[cell]) >= 3:
                expected.append([pools[cell].pop(0) for _ in range(3)])
        if before == len(expected):
            break
    got = sampling.drawn(rows, ["book", "kind"], "id", 9, 3, 5).orderBy("group", "place").collect()
    assert [r.id for r in got] == [i for group in expected for i in group]
    sets = sampling.question_sets(rows, ["book", "kind"], "book", "id", 10, (0.5, 0.3, 0.2))
    used = [r.id for r in sets["single_hop"].collect()] + [r.id for r in sets["aggregation"].collect()] + [i for r in sets["cross_book"].collect() for i in (r.left, r.right)]
    assert len(used) == len(set(used)) == 5 + 9 + 4


def test_reports(spark, tmp_path):
    schema = reports.RECORD
    row = lambda trace, at: (trace, at, "web", "why?", [1], 1.0, 0.5, '{"answer": "a", "pipeline_trace": {"x": 1}}', {"n": "long text"})
    folder = str(tmp_path / "a")
    reports.save(spark.createDataFrame([row("t1", "2020-01-01"), row(None, "2020-01-02")], schema), folder, evidence_chars=4)
    reports.save(spark.createDataFrame([row("t1", "2020-01-03")], schema), folder)
    found = reports.listed(reports.load(spark, folder, "index")).collect()
    assert [r.created_at for r in found] == ["2020-01-03", "2020-01-02"] and len(found[1].trace_id) == 32
    kept = reports.load(spark, folder, "records").filter("created_at = '2020-01-01'").first()
    assert kept.response == '{"answer":"a"}' and kept.evidence == {"n": "long"}
    gone, missing = reports.delete(spark, folder, str(tmp_path / "b"), spark.createDataFrame([("t1",), ("t9",), (" ",)], "trace_id string"))
    assert ([r.trace_id for r in gone.collect()], [r.trace_id for r in missing.collect()]) == (["t1"], ["t9"])
    assert reports.load(spark, str(tmp_path / "b"), "index").count() == 1


def test_layout(spark):
    answer = '```json\n[{"bbox": [0, 0, 1, 1], "category": "Title", "text": "A\\n b"}, {"bbox": [0, 0, 1, 1], "category": "Picture"}, {"bbox": [1], "category": "Text", "text": "no"}, {"bbox": [0, 0, 1, 1], "category": "Page-footer", "text": "3"}, {"bbox": [0, 0, 1, 1], "category": "Picture"}, {"bbox": [0, 0, 1, 1], "category": "Formula", "text": "a\\\\b"}]\n```'
    rows = spark.createDataFrame([(answer, 7), ("so [1]", 1), (None, 1), ('x [{"bbox": ["a", 0, 0, 0], "category": "Text"}]', 1)], "a string, page int")
    got = [r.m for r in rows.select(layout.cells("a").alias("c"), "page").select(layout.page_markdown(F.col("c"), F.col("page")).alias("m")).collect()]
    assert got == ["# A b\n\n![image](image_p7_0.jpg)\n\n![image](image_p7_1.jpg)\n\n$$\na\\b\n$$", "", "", ""]
    assert layout.layout_cells('{"cells": []}') == [] and layout.layout_cells('x [{"bbox": ["a", 0, 0, 0], "category": "T"}]') is None


def test_question_files(spark):
    files = spark.createDataFrame([('{"questions": [{"question": " a ", "id": 5}, {"query": "b"}, 3, {"x": 1}]}',), ('[{"question": " ", "question_text": "c", "qid": "z"}]',), ("nonsense",), (None,)], "value string")
    assert sorted(map(tuple, questions.questions(files).collect())) == [("2", "b"), ("5", "a"), ("z", "c")]
    items = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    progress = spark.createDataFrame([("1", "ok", 1, "r"), ("2", "error", 3, None), ("3", "error", 1, None)], "id string, status string, attempts int, reference string")
    assert sorted(r.id for r in questions.pending(items, progress).collect()) == ["3", "4"]
    assert [r.reference for r in questions.finished(items, progress).collect()] == ["r"]


def test_filing_catalogs(spark):
    raw = '{"filings": {"recent": {"accessionNumber": ["a", " ", "b"], "filingDate": ["2020-01-01"], "form": ["10-K", "8-K", "10-Q"]}}}'
    got = questions.recent_filings(spark.createDataFrame([(raw,), ("{}",), (None,)], "value string")).orderBy("accession").collect()
    assert [tuple(r) for r in got] == [("a", "2020-01-01", "10-K", ""), ("b", "", "10-Q", "")]
    files = spark.createDataFrame([("f", 0, "a-index.html", "99"), ("f", 1, "b.htm", "5"), ("f", 2, "c.HTM", "5"), ("f", 3, "d.pdf", "9"), ("g", 0, "e.html", "x")], "filing string, position int, name string, size string")
    assert sorted(map(tuple, questions.largest_body(files, ["filing"]).collect())) == [("f", "b.htm"), ("g", "e.html")]


def test_packed_context(spark):
    rows = spark.createDataFrame([("q", 1, "a.pdf", 0, "T", "text", "x"), ("q", 2, None, None, None, "image", "y"), ("q", 3, "c", 1, "", "text", "z" * 99), ("q", 4, "d", 1, "", "text", "w"), ("r", 1, "a", 0, "", "text", "z" * 99)], "query_id string, rank long, filename string, page_no int, title string, kind string, text string")
    got = {r.query_id: (r.context, r.parts) for r in evidence.packed_context(rows, 60).collect()}
    assert got == {"q": ("[1] a.pdf 第1页 · T\nx\n\n[2]  第1页\n（图片描述）y", 2), "r": ("", 0)}
    none = texts()
    queries = [evidence.second_query(F.lit(" q "), none, F.lit(None).cast("string"), none), evidence.second_query(F.lit("q"), texts("a", "b"), F.lit("rag"), texts("t"))]
    assert tuple(spark.range(1).select(*[q.alias(str(i)) for i, q in enumerate(queries)]).first()) == ("q", "q\n\nLikely filings: a, b\nCoordination mode: rag-led\nNarrative targets: t")


def test_copied_runs_and_soft_scores(spark, monkeypatch):
    questions_ = spark.createDataFrame([(1, "abcd efgh"), (2, None), (3, "ab")], "question_id long, text string")
    docs = spark.createDataFrame([(1, "xxabc\ndex abcde"), (2, ""), (3, None)], "text_id long, text string")
    blocked = sorted(r.w for r in evaluation.char_windows(questions_, "question_id", "text", 4, 2).collect())
    assert blocked == sorted("abcdefgh"[i : i + 4] for i in range(5))
    for most in (100, 0):
        monkeypatch.setattr(evaluation, "BROADCAST_WINDOWS", most)
        assert [tuple(r) for r in evaluation.copied_runs(questions_, docs, 4).collect()] == [(1, 1, 2)]
    scores = spark.createDataFrame([("a", 0.5), ("a", None), ("a", float("nan")), ("b", None)], "metric string, score double")
    assert sorted(map(tuple, evaluation.soft_scores(scores).collect())) == [("a", 1, 2, 0.5), ("b", 0, 1, None)]
    assert tables.cleanup_blockers(docs.limit(0), docs, 3) == ["nothing known while files exist", "read 0 of 3 rows"]
    assert tables.cleanup_blockers(docs, docs, 3) == []
