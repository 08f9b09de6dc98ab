from pyspark.sql import functions as F

from lodestone.operators import quotes

NODE = "query_id long, node_id string, document_id long, text string, score double, rerank_score double, accns array<string>"
SENTENCE = "Revenue rose because demand for services was strong in all regions."


def test_gates_of_quotes(spark):
    nodes = spark.createDataFrame(
        [(1, "a", 7, f"Intro.\r\n{SENTENCE}\r\nMore of the text that follows here.", 0.2, 0.9, []), (1, "b", 7, "x" * 50, 0.6, None, ["acc-b", "z"]), (1, "c", None, SENTENCE.upper() + " And then some.", 0.1, None, None), (1, "d", 8, None, None, None, ["acc-d"]), (2, "a", 7, SENTENCE, 0.5, None, [])],
        NODE,
    )
    seen = quotes.sources(nodes, limit=4)
    found = [tuple(r) for r in seen.filter("query_id = 1").orderBy("source_index").select("node_id", "relevance", "accn").collect()]
    assert found == [("a", 0.9, "acc-b"), ("b", 0.6, "acc-b"), ("c", 0.1, None), ("d", 0.0, "acc-d")]
    assert quotes.sources(nodes, limit=4, seen=5).filter("node_id = 'a' and query_id = 1").first().excerpt == "Intro"
    given = [
        (1, 1, 1, f" {SENTENCE}\n"), (1, 2, 1, f"Intro.\n{SENTENCE}"), (1, 3, 1, "too short"), (1, 4, 1, None), (1, 5, 9, SENTENCE), (1, 6, 1, SENTENCE.replace("rose", "fell")), (1, 7, 1, SENTENCE), (1, 8, 3, SENTENCE.upper()), (1, 9, 2, "x" * 45),
        (1, 10, 1, "| a | b |\n| c | d | and words to be long enough |"), (1, 11, 3, SENTENCE.upper() + " And"), (1, 12, 1, "More of the text that follows here."), (1, 13, 1, "x" * 2000), (2, 1, 1, SENTENCE),
    ]
    judged = {(r.query_id, r.position): r for r in quotes.verified(spark.createDataFrame(given, "query_id long, position long, source_index long, text string"), seen, limit=3, least=35).collect()}
    assert {k: r.verdict for k, r in judged.items()} == {
        (1, 1): "kept", (1, 2): "kept", (1, 3): "length", (1, 4): "length", (1, 5): "source", (1, 6): "not verbatim", (1, 7): "repeated", (1, 8): "repeated", (1, 9): "kept", (1, 10): "table", (1, 11): "no document", (1, 12): "beyond", (1, 13): "length", (2, 1): "kept",
    }
    first = judged[1, 1]
    assert (first.body, first.node_id, first.document_id, first.accn, first.place, first.level) == (SENTENCE, "a", 7, "acc-b", 1, "high")
    assert judged[1, 6].body is None and judged[2, 1].level == "medium" and judged[2, 1].accn is None


def test_tables_are_told_by_their_first_lines(spark):
    rows = [("a | b | c", False), ("a | b | c\nd | e | f", True), ("a | b | c\n\nd", False), ("| | \n| |\nx\ny", True), ("| |\n| |\nx\ny\nz", False), (None, False), ("", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.filter(quotes.mostly_table(F.col("t")) != F.col("want")).count() == 0
