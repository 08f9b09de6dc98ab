from pyspark.sql import functions as F

from lodestone.functions import pages
from lodestone.operators import planning, tables
from lodestone.streaming import windows


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def texts(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_titles_carry_over_pages(spark):
    md = [(1, 1, "lead\n# A\nx\n## B\ny"), (1, 2, "still B\n### C\n![image](i.jpg)\n\nz\n## D\n#### not\nw"), (1, 3, "# E"), (2, 1, "other"), (3, 1, None)]
    rows = spark.createDataFrame(md, "document_id long, page_no int, md string")
    found = [(r.page_no, r.title, r.body) for r in pages.sections(rows).filter("document_id = 1").orderBy("page_no", "section").collect()]
    assert found == [(1, "", "lead"), (1, "A", "x"), (1, "A --> B", "y"), (2, "A --> B", "still B"), (2, "A --> B --> C", "![image](i.jpg)\n\nz"), (2, "A --> D", "#### not\nw"), (3, "E", "")]
    chunks = pages.page_chunks(rows, 5).orderBy("document_id", "page_no", "section", "place").collect()
    assert [(c.kind, c.text or c.image_name) for c in chunks if c.document_id == 1 and c.page_no == 2] == [("text", "still"), ("text", "B"), ("image", "i.jpg"), ("text", "z"), ("text", "####"), ("text", "not\nw")]
    assert [c.text for c in chunks if c.document_id == 2] == ["other"]


def test_semantic_pieces(spark):
    vectors = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((1.0, 0.0), (1.0, 0.1), (0.0, 1.0), (0.0, 1.0))])
    cut = pages.semantic_pieces(texts("aaaa. ", "bbbb. ", "cccc. ", "dddd."), vectors, 20, 50.0)
    short = pages.semantic_pieces(texts("a", "b", "c", "d"), vectors, 40, 50.0)
    bare = pages.semantic_pieces(texts("abc", "def"), F.array(F.lit(None).cast("array<double>")), 4)
    assert one(spark, cut, short, bare, pages.semantic_pieces(texts("a"), F.array(vectors[0]), 4)) == (["aaaa. bbbb. ", "cccc. dddd."], ["abcd"], ["abcd", "ef"], ["a"])
    assert one(spark, pages.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))))[0] == 1.0


def test_changes_to_stores(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "B"), (2, None)], "document_id long, text string")
    changed, counts = tables.rebuilt_texts(nodes, F.upper("text"))
    assert [r.text for r in changed.collect()] == ["A"] and sorted(map(tuple, counts.collect())) == [(1, 2, 1), (2, 1, 0)]
    left = tables.without_documents({"index": nodes, "documents": nodes}, spark.createDataFrame([(1,), (1,)], "document_id long"))
    assert list(left) == ["index", "documents"] and [r.document_id for r in left["documents"].collect()] == [2]
    files = lambda *rows: spark.createDataFrame([(n, c.encode()) for n, c in rows], "name string, content binary")
    assert sorted(map(tuple, tables.copy_differences(files(("a", "1"), ("b", "12"), ("c", "x"), ("e", "s")), files(("b", "1"), ("c", "y"), ("d", ""), ("e", "s"))).collect())) == [("a", "missing"), ("b", "size"), ("c", "content"), ("d", "extra")]
    jobs = spark.createDataFrame([(1, "running", "1"), (2, "failed", "2"), (3, "completed", "3"), (4, None, "0")], "job_id long, status string, created_at string")
    assert 3 in {r.job_id for r in tables.kept_jobs(jobs, 3).collect()} and {r.job_id for r in tables.kept_jobs(jobs, 1).collect()} == {1, 4}


def test_targets(spark):
    assert one(spark, planning.titled_for(F.lit("Net Sales"), texts("revenue")), planning.titled_for(F.lit("going concern"), texts("going_concern")), planning.titled_for(F.lit("x"), texts()), planning.titled_for(F.lit(None).cast("string"), texts("revenue"))) == (True, True, False, False)
    hints = one(spark, planning.soft_hints(texts("liquidity", "going_concern", "nothing")))[0]
    assert hints.section_role == ["liquidity"] and hints.rerank_terms == ["liquidity", "capital resources", "working capital", "going concern", "substantial doubt"]
    got = one(spark, planning.rerank_queries(F.lit(" q "), texts("risk_factors")), planning.rerank_queries(F.lit("q"), texts("management_discussion"), 1), planning.rerank_queries(F.lit("q"), texts()), planning.rerank_queries(F.lit(None).cast("string"), texts("risk_factors")))
    assert [len(x) for x in got] == [3, 1, 1, 1] and got[0][0] == "q" and got[0][1].startswith("q\nFocus: distribution")
    assert tuple(one(spark, planning.section_policy(texts("Liquidity")))[0]) == (True, True, 2.0)
    assert one(spark, planning.scenario(F.lit("A Comment Letter")), planning.scenario(F.lit(None).cast("string"))) == ("compliance", "research")
    assert one(spark, planning.risk_flags(F.lit(0), F.lit(1), F.lit("x"), texts("filing_divergence")))[0] == ["no_citations", "limitations", "filing_divergence"]


def test_windows_let_through_their_limit(spark, tmp_path):
    assert windows.admit([0, 1, 2, 70], None, 0, 2, 60) == ([0, 1, 60, 70], 60, 2)
    assert windows.admit([], 5.0, 1, 2, 60) == ([], 5.0, 1)
    like = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 4, 2.0)], "key string, request_id long, at double")
    like.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.admitted(windows.read_tables(spark, str(tmp_path / "in"), like), 2)
    query = stream.writeStream.format("memory").queryName("let_through").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.request_id, r.admitted_at) for r in spark.table("let_through").collect()) == [(1, 0.0), (2, 1.0), (3, 60.0), (4, 2.0)]
    changes = spark.createDataFrame([(1, "ingesting", 1), (1, "completed", 2), (1, "ingesting", 3), (2, "ingesting", 1)], "document_id long, status string, at long")
    assert sorted(map(tuple, windows.latest_status(changes).collect())) == [(1, "completed"), (2, "ingesting")]
