import pytest
from pyspark.sql import functions as F

from lodestone.functions import formats, narrative
from lodestone.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_fact_values(spark):
    none = F.lit(None).cast("string")
    values = (1.5e9, 1234.5, 12.34567, 100.0, 0.0, -2500.0)
    assert one(spark, *[formats.fact_value(F.lit(v), none) for v in values]) == ("1,500,000,000", "1,234.50", "12.3457", "100", "0", "-2,500.00")
    nothing = F.lit(None).cast("double")
    assert one(spark, formats.fact_value(nothing, F.lit(" yes ")), formats.fact_value(nothing, none)) == ("yes", "n/a")


def test_fact_lines(spark):
    schema = "document_id long, taxonomy string, metric_key string, metric_label string, value_numeric double, value_text string, unit string, period_end string, filed_date string, form string, fy int, fp string, accn string"
    rows = spark.createDataFrame([(1, "us-gaap", f"M{i}", None, 1e9 * i, None, "USD", "2020-12-31", None, "10-K", 2020, "FY", "a") for i in (1, 2, 3)], schema)
    lines = formats.fact_lines(rows, ["document_id"], [F.col("metric_key")], 2).first().lines.split("\n")
    assert lines[0] == "1. doc=1 | us-gaap.M1 |  | 1000000000.0 USD | end=2020-12-31 filed=None form=10-K fy=2020 fp=FY accn=a"
    assert lines[2] == "... (1 more rows omitted)"


def test_scores_dates_years(spark):
    got = one(spark, *[formats.score_value(F.lit(v)) for v in (float("nan"), -1.0, 2.0, 0.00005, 0.12345)])
    assert got == (0.0, 0.0, 1.0, 0.0001, 0.1235)
    assert one(spark, formats.iso_date(F.lit("2020-01-02T03")), formats.iso_date(F.lit(" x ")), formats.iso_date(F.lit(" "))) == ("2020-01-02", "x", None)
    assert one(spark, formats.fiscal_year(F.lit("1989")), formats.fiscal_year(F.lit("2020")), formats.fiscal_period(F.lit(" q1 "))) == (None, 2020, "Q1")
    assert one(spark, formats.years_among(F.array(F.lit("2020"), F.lit("x"), F.lit("2020"), F.lit("1900"))))[0] == [2020]


def test_natural_order(spark):
    names = spark.createDataFrame([("ch10.pdf",), ("ch2.pdf",), ("Ch02b.pdf",), ("1.pdf",)], "name string")
    assert [r.name for r in names.orderBy(formats.natural_key(F.col("name"))).collect()] == ["1.pdf", "ch2.pdf", "Ch02b.pdf", "ch10.pdf"]
    rows = formats.book_chapters(names, "name", "B", 3).orderBy("chapter_index").collect()
    assert rows[0].chapter_label == "B · 第3章 · 1" and rows[-1].chapter_index == 6


def test_keys(spark):
    ok = [formats.asset_key_ok(F.lit(i), F.lit(n)) for i, n in ((1, "a.jpg"), (0, "a"), (1, "../a"), (1, ""))]
    assert one(spark, *ok) == (True, False, False, False)
    assert one(spark, formats.collection_name_ok(F.lit("books_1")), formats.collection_name_ok(F.lit("1b"))) == (True, False)


def test_answers_of_models(spark):
    assert one(spark, formats.fenced(F.lit("x ```mermaid\na-->b\n``` y"), "mermaid"), formats.fenced(F.lit("```\nq\n```"), "mermaid"), formats.fenced(F.lit(" z "), "mermaid")) == ("a-->b", "q", "z")
    assert one(spark, formats.model_json(F.lit('so: {"a": 1} end')), formats.model_json(F.lit("{a")), formats.model_json(F.lit("{'a' b}"))) == ('{"a": 1}', None, None)
    refs = ("<think>x</think> yes", '```json\n{"answer": "a"}\n```', None)
    assert one(spark, *[formats.reference_text(F.lit(r).cast("string")) for r in refs]) == ("yes", "a", "")
    assert one(spark, formats.context_texts(F.lit('["a", {"text": "b"}, " "]')), formats.context_texts(F.lit("x")), formats.context_texts(F.lit(None).cast("string"))) == (["a", "b"], [], [])


def test_image_sizes_and_formulas(spark):
    sizes = [formats.image_size(F.lit(w), F.lit(h)) for w, h in ((100, 50), (1, 1), (10000, 10000), (0, 5))]
    got = [s and tuple(s) for s in one(spark, *sizes)]
    assert got[0] == (112, 56) and got[1] == (56, 56) and got[3] is None
    assert got[2][0] % 28 == 0 and got[2][0] * got[2][1] <= formats.MOST_PIXELS
    texts = ("$$a$$", "\\[ a \\]", "a\\b", "$a$", "a")
    assert one(spark, *[formats.formula(F.lit(t)) for t in texts]) == ("$$a$$", "$$\na\n$$", "$$\na\\b\n$$", "$a$", "a")


def test_shared_runs_and_leaks(spark):
    assert formats.shared_runs("abcdefghij xyz", "__abcde fghij__", 8) == ["abcdefghij"]
    assert formats.shared_runs(None, "a", 8) == formats.shared_runs("short", "short", 8) == []
    rows = spark.createDataFrame([("abcdefgh qrstuvwx", "abcdefgh.qrstuvwx"), ("abcdefgh", "abcdefgh abcdefgh"), (None, None)], "q string, t string")
    assert [r[0] for r in rows.select(formats.leaks(F.col("q"), F.col("t"))).collect()] == [True, False, False]


@pytest.mark.parametrize(("text", "period"), [("see ASU 2014-15 note", None), ("in 2012Q3 sales", "2012Q3"), ("fiscal year 2013", "2013"), ("room 2014", None), ("2020年第二季度", "2020Q2"), ("2020半年度", "2020H1"), (None, None)])
def test_periods(text, period):
    assert formats.period_of(text) == period


def test_roles(spark):
    path, none = F.array(F.lit("Item 7."), F.lit("Results of Operations")), F.array().cast("array<string>")
    text = F.lit("Sales rose, primarily because of new stores.")
    blank = F.lit("")
    assert one(spark, narrative.section_role(blank, path, text), narrative.leaf_role(blank, path, text)) == ("results_of_operations", "results_driver")
    assert one(spark, narrative.section_role(blank, none, text), narrative.section_role(F.lit("x"), none, text), narrative.leaf_role(blank, none, blank)) == (None, "unknown", None)
    assert one(spark, narrative.topics(blank, none, F.lit("Gross margin and net sales")))[0] == ["revenue", "gross_margin"]
    assert one(spark, narrative.domain(F.lit("合并利润表")), narrative.statement(F.lit("合并利润表")), narrative.metric_names(F.lit("净利润"))) == ("finance", "income_statement", ["net_profit"])
    assert one(spark, narrative.search_hints(F.array(F.lit("a"), F.lit(" ")), F.array(F.lit("b"), F.lit("a"))))[0] == "a b"


def test_citable(spark):
    zero = F.lit(0)
    long = "This is a sentence of some length that says what happened. " * 10
    got = one(spark, *[narrative.citable(F.lit(t).cast("string"), zero) for t in (long, "short", None, "TABLE | a | b\n" * 40)])
    assert (got[0].score, got[0].blocked, got[0].flags) == (2.4, False, [])
    assert got[1].flags == ["too_short", "heading_only"] and got[2].blocked
    assert got[3].flags == ["no_sentence", "table_heavy"] and got[3].score == -1.0
    assert tuple(one(spark, narrative.answerable(F.lit(long), zero, F.lit(0.2)))[0]) == (False, True)
    assert tuple(one(spark, narrative.answerable(F.lit(long), zero, F.lit(None).cast("double")))[0]) == (False, False)


def test_questions_and_sources(spark):
    assert one(spark, narrative.question_years(F.lit("ASU 2014-15 in FY2012 and 2013 or 2012")))[0] == ["2012", "2013"]
    assert one(spark, narrative.question_forms(F.lit("the annual report and 10-Qs")))[0] == ["10-K", "10-Q"]
    assert one(spark, narrative.count_hints(F.lit("EPS and steps, 风险"), ("eps", "风险", "cash")))[0] == 2
    assert one(spark, narrative.is_advert(F.lit("13912345678")), narrative.is_advert(F.lit("老师")), narrative.is_advert(F.lit("老师 微信")), narrative.is_advert(F.lit(None).cast("string"))) == (True, False, True, False)
    got = one(spark, narrative.source_quality(F.lit("Fees and time"), F.lit("x" * 150), F.lit("a.Example.org"), ("example.org",), ("fees", "time")))
    assert got[0] == pytest.approx(0.8 + 0.4 + 0.5)
    assert one(spark, narrative.selector_key(F.lit("Acme | Q3 2017 Form 10-Q | 15\nIn 2020, 1,200 units in Q2")))[0] == "in <year> , <num> units in"


def test_citable_looks_at_a_text_once(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    found = rows.select(narrative.citable(F.col("text"), T.causal_signals(F.col("text"))).alias("c"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert [plan.count(name) for name in ("regexp_count(", "split(", "see item 1a", "resulted in")] == [1, 1, 1, 1]
    assert plan.count("lower(") <= 3
