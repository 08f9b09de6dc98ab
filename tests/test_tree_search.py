import pytest
from pyspark.sql import functions as F

from lodestone.operators import hierarchical, search
from lodestone.plans import tree_queries
from tests.conftest import SF, multiset


@pytest.mark.parametrize(("query", "sql"), [("hierarchical_search", "hierarchical_sql"), ("scoped_search", "scoped_sql"), ("section_expansion", "expansion_sql")])
def test_more_questions_agree_with_sql(spark, duck, query, sql):
    got = getattr(tree_queries, query)(spark, SF, every=8).toPandas()
    assert got["query_id"].nunique() == 5
    assert multiset(got) == multiset(duck.execute(getattr(tree_queries, sql)(8)).df())


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("d", 1, None, 1, 0, "red apples"), ("s0", 1, "d", 2, 0, "red things"), ("s1", 1, "d", 2, 1, "blue things"), ("t0", 1, "s0", 3, 0, "red deep"), ("l0", 1, "s0", 0, 0, "a head"), ("l1", 1, "s0", 0, 1, "apples are red"), ("l2", 1, "s0", 0, 2, "more of it"), ("l3", 1, "s1", 0, 0, "blue sky"), ("l4", 1, "t0", 0, 0, "deep down"), ("x", 2, None, 1, 0, None)]
    return spark.createDataFrame([(*r, "src") for r in rows], "node_id string, document_id long, parent_id string, level long, order_index long, text string, source string")


def test_narrative_questions_take_all_leaves_below_sections(spark, tree):
    asked = spark.createDataFrame([(1, "red"), (2, ""), (3, "nothing here")], "query_id long, query string")
    found = hierarchical.retrieve(asked, tree, hierarchical.Budget(per_source=9), narrative=True).collect()
    assert {r.query_id for r in found} == {1}
    assert {r.node_id for r in found} == {"l0", "l1", "l2", "l3", "l4"}
    ordinary = hierarchical.retrieve(asked, tree, hierarchical.Budget(per_source=9)).collect()
    assert {"l0", "l1", "l2", "s0", "s1"} <= {r.node_id for r in ordinary if r.query_id == 1}


def test_leaves_below_carry_their_own_parents_score(spark, tree):
    sections = spark.createDataFrame([(1, "d", 0.5, None, 0.1), (1, "s0", None, 2.0, 0.1)], "query_id long, node_id string, dense_score double, sparse_score double, fusion_score double")
    found = {r.node_id: r.section_score for r in hierarchical.leaves_below(tree, sections).collect()}
    assert found == {"l0": 2.0, "l1": 2.0, "l2": 2.0, "l3": 0.0, "l4": 0.0}
    kids = {r.node_id: r.fusion_score for r in hierarchical.scored_children(tree, sections).collect()}
    assert kids == {"s0": 0.5, "s1": 0.5, "t0": 2.0, "l0": 2.0, "l1": 2.0, "l2": 2.0}


def test_siblings_follow_the_earliest_heading(spark, tree):
    heads = spark.createDataFrame([(1, "s0", 2), (1, "s0", 1), (1, None, 0), (2, "s1", None)], "query_id long, parent_id string, order_index long")
    found = sorted((r.query_id, r.node_id) for r in hierarchical.following_siblings(heads, tree, 2).collect())
    assert found == [(1, "l1"), (1, "l2"), (2, "l3")]


def test_merged_candidates_keep_the_better_row(spark, tree):
    payload = ", ".join(f"{c} {t}" for c, t in zip(hierarchical.NODE, ("long", "string", "long", "long", "string"), strict=True))
    rows = lambda *x: spark.createDataFrame([(1, n, b, 1, None, 0, 0, "s", *scores) for n, b, *scores in x], f"query_id long, node_id string, bucket string, {payload}, sparse_score double, fusion_score double")
    base, more = rows(("a", "base", 1.0, 0.1), ("b", "base", None, 0.3), ("c", "base", None, None)), rows(("a", "more", 1.0, 0.9), ("b", "more", None, 0.4), ("d", "more", 3.0, None))
    found = [(r.node_id, r.bucket, r["rank"]) for r in hierarchical.merged_candidates(base, more, 3).orderBy("rank").collect()]
    assert found == [("d", "more", 1), ("a", "base", 2), ("b", "more", 3)]


def test_first_payload_and_last_score_of_fused_items(spark):
    payload = "document_id long, parent_id string, level long, order_index long, source string"
    one = spark.createDataFrame([(1, "a", 1, "x", 1, "p", 0, 0, "s", 0.5), (1, "b", 2, "x", 1, "p", 0, 0, "s", 0.4)], f"query_id long, node_id string, rank long, bucket string, {payload}, dense_score double")
    two = spark.createDataFrame([(1, "b", 1, "y", 9, "q", 2, 7, "t", 3.0), (1, "c", 2, "y", 9, "q", 2, 7, "t", 2.0)], f"query_id long, node_id string, rank long, bucket string, {payload}, sparse_score double")
    found = hierarchical.fused_items([one, two], 10).orderBy("rank").collect()
    assert [(r.node_id, r.bucket, r.document_id, r.dense_score, r.sparse_score) for r in found] == [("b", "x", 1, 0.4, 3.0), ("a", "x", 1, 0.5, None), ("c", "y", 9, None, 2.0)]


def test_dense_hits_at_any_block_and_bad_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0]), (7, [3.0, 0.0])], "node_id long, vector array<double>").withColumn("score", F.lit(None).cast("string")).drop("score")
    asked = spark.createDataFrame([(10, [1.0, 0.0], "u"), (11, [0.0, 1.0], "v"), (12, [0.0, 0.0], "w"), (13, None, "x"), (14, [2.0], "y")], "query_id long, query_vector array<double>, note string")
    want = [(10, 1, 1.0, 1, "u"), (10, 7, 1.0, 2, "u"), (11, 2, 1.0, 1, "v"), (11, 1, 0.0, 2, "v"), (14, 6, 1.0, 1, "y")]
    for bound in (search.BROADCAST_BYTES, 60):
        monkeypatch.setattr(search, "BROADCAST_BYTES", bound)
        assert sorted((r.query_id, r.node_id, r.score, r["rank"], r.note) for r in search.dense_topk(asked, rows, 2).collect()) == sorted(want)
    assert search.dense_topk(asked.limit(0), rows, 2).count() == 0 == search.dense_topk(asked, rows.limit(0), 2).count()


def test_terms_asked_for_beyond_the_bound_score_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "A b b"), (2, "b c"), (3, None), (4, ""), (5, "é a-b " * 50)], "node_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "B zz"), (3, None)], "query_id long, query string")
    plain = sorted(map(tuple, search.bm25(asked, docs).collect()))
    monkeypatch.setattr(search, "PIECE", 7)
    assert sorted(map(tuple, search.bm25(asked, docs).collect())) == plain and len(plain) == 6
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, search.bm25(asked, docs).collect())) == plain


def test_nodes_are_cut_from_texts_once(spark):
    nodes, _, _ = tree_queries._setting(spark, "/root/testdata/sf0.001", 100)
    assert "explode" not in nodes._jdf.queryExecution().optimizedPlan().toString()
