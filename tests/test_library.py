from pyspark.sql import functions as F

from lodestone.operators import library


def test_listings(spark):
    docs = spark.createDataFrame(
        [(1, {"source": "m", "status": "completed", "book_id": "b", "chapter_index": "10"}), (2, {"source": "m", "status": "completed", "book_id": "b", "chapter_index": "9"}), (3, {"source": "m", "status": "failed", "book_id": "b", "chapter_index": "x"}),
         (4, {"source": "m", "status": "gone"}), (5, {"source": "n", "status": "completed"}), (6, None), (7, {"source": "m", "status": "ingesting", "chapter_index": "99999999999"})], "document_id long, metadata map<string,string>")
    found = {r.document_id: (r.chapter_index, r.place) for r in library.inventory(docs, "m").collect()}
    assert found == {2: (9, 1), 1: (10, 2), 3: (None, 3), 7: (None, 1)}
    assert [r.document_id for r in library.inventory(docs, "m", ("completed",)).orderBy("place").collect()] == [2, 1]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "node_id string, v int")
    asked = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "node_id string, place long")
    assert sorted((r.place, r.node_id) for r in library.points(rows, asked).collect()) == [(0, "b"), (1, "a")]
    tree = spark.createDataFrame([("r", 1, 2, 0), ("l1", 1, 0, 1), ("l0", 1, 0, 0), ("x", 2, 0, 0)], "node_id string, document_id long, level long, order_index long")
    assert [r.node_id for r in library.nodes_of(tree, 1).collect()] == ["r", "l0", "l1"]


def test_prefixes_values_and_urls(spark):
    texts = spark.createDataFrame([("prefix body", 7), ("body", 4), ("body", 5), ("body", 0), ("body", -1), ("body", None), (None, 3)], "t string, n int")
    assert [r[0] for r in texts.select(library.without_prefix(F.col("t"), F.col("n"))).collect()] == ["body", "", "body", "body", "body", "body", None]
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), (" ", 5), (None, 6), ("c", 7), (" ", 8)], "v string, i long")
    assert [tuple(r) for r in library.most_frequent(rows, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert [r.v for r in library.distinct_values(rows, "v", 0).collect()] == [" "] and library.distinct_values(rows, "v", 9999).count() == 4
    assert sorted(r.i for r in library.once_by_url(rows, "v", ["i"]).collect()) == [1, 2, 5, 6, 7, 8]


def test_names_of_documents(spark):
    accn = "0000320193-17-000009"
    rows = [
        (1, f"EDGAR 10-K | {accn}", None, {"entity_name": "Acme", "filed": "2017-11-03", "cik": "5"}), (2, None, f"/x/EDGAR_320193_{accn}.htm", None), (3, "t", "/x/report.pdf", {}), (4, " T ", None, {"entity_name": " "}), (5, None, None, None), (6, "x/..", None, {"accn": " 7 ", "form": f"8-K {accn}", "sec_accession": accn}),
    ]
    docs = spark.createDataFrame(rows, "document_id long, title string, source_uri string, metadata map<string,string>").withColumn("f", library.display_fields(F.col("title"), F.col("source_uri"), F.col("metadata")))
    found = [tuple(r) for r in docs.select(library.display_name(F.col("document_id"), F.col("title"), F.col("source_uri"), F.col("f")), "f.cik", library.subtitle(F.col("document_id"), F.lit(""), F.col("f.accn"))).collect()]
    assert found == [(f"Acme · 10-K · 2017-11-03 · {accn}", "5", f"ID 1 · {accn}"), (f"EDGAR · {accn}", "320193", f"ID 2 · {accn}"), ("report.pdf", None, "ID 3"), ("T", None, "ID 4"), ("Document 5", None, "ID 5"), (f"8-K {accn}", None, f"ID 6 · {accn}")]


def test_documents_of_hits(spark):
    rows = [(1, 5, "a", 3.0, None, "x" * 300, 4), (1, 5, "b", 0.5, "t", None, None), (1, 5, "c", 0.4, "t", "c", 0), (1, 5, "d", 0.3, "t", "d", 0), (1, 6, "e", None, "six", "e", 1), (1, 7, "f", 0.9, "seven", "f", 1), (2, 7, "f", 0.1, "", "f", 1)]
    hits = spark.createDataFrame(rows, "query_id long, document_id long, node_id string, score double, title string, text string, order_index int")
    found = {(r.query_id, r.place): (r.document_id, r.title, r.score, [(c.section_number, c.node_id, len(c.text_preview)) for c in r.top_chunks], r.n_documents) for r in library.documents_of_hits(hits, 2).collect()}
    assert found == {(1, 1): (5, "文档 5", 1.0, [(5, "a", 200), (1, "b", 0), (1, "c", 1)], 3), (1, 2): (7, "seven", 0.9, [(2, "f", 1)], 3), (2, 1): (7, "文档 7", 0.1, [(2, "f", 1)], 1)}
