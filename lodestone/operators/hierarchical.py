"""Retrieval over a section tree: sections and leaves are searched apart, and sections found bring what is below them.

Nodes are node_id, document_id, parent_id, level (0 a leaf, above it sections), order_index,
source, text. A branch searches the nodes of some levels by words and by vectors and fuses the
two lists. The hits of the section branch decide the second list of the leaf branch: their
children, or all leaves below them. Both are fused again, reranked by whatever the caller gives,
limited by source and kind, and the best bring their siblings as context. Everything is joins,
windows and limits over all questions at once; what a question can hold is bounded by Budget.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import search, selectors, trees
from lodestone.session import settled

NODE = ("document_id", "parent_id", "level", "order_index", "source")
SCORES = ("dense_score", "sparse_score")
#: What a child of a section counts as a candidate, and the least that a section's score counts for its children.
CHILD_SCORE = 0.2
Hint = Callable[[DataFrame], DataFrame]
#: About what a hit holds.
ROW_BYTES = 256


@dataclass(frozen=True)
class Budget:
    """How much each step keeps for a question."""

    summary: int = 6
    leaf: int = 20
    candidates: int = 30
    per_side: int = 30
    per_source: int = 3
    kept: int = 12
    seeds: int = 3
    siblings: int = 8
    decay: float = 0.8
    per_heading: int = 6

    def fused(self) -> int:
        return max(self.candidates, self.leaf + self.summary)

    def hint(self, questions: DataFrame) -> Hint:
        """Broadcasts what these budgets keep of the questions, if all of it fits search.BROADCAST_BYTES at ROW_BYTES a row; one count decides for all steps."""
        few = questions.count() * max(self.per_side, self.fused()) * ROW_BYTES <= search.BROADCAST_BYTES
        return F.broadcast if few else lambda hits: hits


def fused_items(lists: list[DataFrame], limit: int) -> DataFrame:
    """lists of (query_id, node_id, rank, ...) -> query_id, node_id, rank, fusion_score, the columns of NODE and `bucket` of the first list that has the node, and of each of SCORES the value of the last.

    Of equal fusion scores the higher level comes first, then what appears first, list after list.
    """
    numbered = [x.withColumn("list_no", F.lit(i)).withColumns({s: F.lit(None).cast("double") for s in SCORES if s not in x.columns}) for i, x in enumerate(lists)]
    columns = ["query_id", "node_id", "rank", "list_no", "bucket", *NODE, *SCORES]
    both = reduce(DataFrame.unionByName, [x.select(columns) for x in numbered])
    first = F.struct("list_no", "rank")
    found = both.groupBy("query_id", "node_id").agg(
        F.round(F.sum(F.lit(1.0) / (search.RRF_K + F.col("rank"))), 9).alias("fusion_score"), F.min(first).alias("first_seen"), F.min_by(F.struct("bucket", *NODE), first).alias("node"),
        *[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("list_no"))).alias(s) for s in SCORES],
    )
    found = found.select("query_id", "node_id", "fusion_score", "first_seen", "node.*", *SCORES)
    order = W.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), F.col("level").desc(), "first_seen", "node_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).drop("first_seen")


def in_scope(hits: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Hits in the documents that scope(query_id, document_id) names; of a question that it doesn't name all."""
    if scope is None:
        return hits
    named = scope.select("query_id").distinct().withColumn("named", F.lit(True))
    inside = scope.filter("document_id is not null").select("query_id", "document_id").distinct().withColumn("inside", F.lit(True))
    marked = hits.join(F.broadcast(named), "query_id", "left").join(inside, ["query_id", "document_id"], "left")
    return marked.filter("named is null or inside").drop("named", "inside")


def branch(questions: DataFrame, nodes: DataFrame, budget: Budget, limit: int, bucket: str, vectors: tuple[DataFrame, DataFrame] | None = None, scope: DataFrame | None = None, small: Hint = search.bounded) -> DataFrame:
    """One search over nodes: by words, by vectors(query_id, query_vector; node_id, vector), fused; at most `limit` a question, few of one source before others."""
    lists = []
    payload = nodes.select("node_id", *NODE)
    if vectors is not None:
        asked, held = vectors
        held = held.join(payload, "node_id")
        if scope is None:
            near = search.dense_topk(asked, held, budget.per_side)
        else:  # every question has rows of its own
            pairs = in_scope(held.crossJoin(search.bounded(asked)), scope)
            scored = pairs.withColumn("score", F.round(search.cosine(F.col("vector"), F.col("query_vector")), 6)).filter("score is not null")
            near = search.ranked(scored.drop("vector", "query_vector"), "score", "node_id", ["query_id"], budget.per_side)
        lists.append(near.withColumnRenamed("score", "dense_score"))
    if scope is None:
        scores = search.bm25(questions, nodes.select("node_id", "text"))
    else:  # the document goes along, so that hits need no join with all nodes
        words = search.bm25(questions, nodes.select(F.struct("node_id", "document_id").alias("node_id"), "text"))
        scores = in_scope(words.select("query_id", "node_id.node_id", "node_id.document_id", "score"), scope)
    top = search.ranked(scores.select("query_id", "node_id", "score"), "score", "node_id", ["query_id"], budget.per_side)
    lists.append(small(top.withColumnRenamed("score", "sparse_score")).join(payload, "node_id"))
    hits = fused_items([x.withColumn("bucket", F.lit(bucket)) for x in lists], max(limit, budget.kept // 2))
    return settled(search.source_limit(hits, limit, budget.per_source, ["query_id"]))


def children(nodes: DataFrame, sections: DataFrame, limit: int, small: Hint = search.bounded) -> DataFrame:
    """The first `limit` nodes under each section of sections(query_id, node_id, rank), as a list: lower levels first, then by order_index."""
    below = nodes.select("node_id", *NODE).join(small(sections.select("query_id", F.col("node_id").alias("parent_id"), F.col("rank").alias("of"))), "parent_id")
    first = trees.first_per(below, ["query_id", "parent_id"], ["order_index", "node_id"], limit).drop("place")
    order = W.partitionBy("query_id").orderBy("level", "order_index", "of", "node_id")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).drop("of")


def leaves_below(nodes: DataFrame, sections: DataFrame, depth: int = 4) -> DataFrame:
    """All leaves below the sections of sections(query_id, node_id, ...), each once, with `section_score`: that of the leaf's own parent if it is among them, else 0.

    `depth` joins, one a level of the tree, each on parent_id.
    """
    tree = nodes.select("node_id", *NODE)
    scored = sections.select("query_id", F.col("node_id").alias("parent_id"), search.evidence_score(F.lit(None).cast("double"), *map(F.col, (*SCORES, "fusion_score"))).alias("section_score"))
    at, found = sections.select("query_id", "node_id"), []
    for _ in range(depth):
        step = settled(tree.join(search.bounded(at.withColumnRenamed("node_id", "parent_id")), "parent_id"))
        found.append(step.filter("level = 0"))
        at = step.filter("level > 0").select("query_id", "node_id").distinct()
    leaves = reduce(DataFrame.unionByName, found).dropDuplicates(["query_id", "node_id"])
    return leaves.join(scored, ["query_id", "parent_id"], "left").withColumn("section_score", F.coalesce("section_score", F.lit(0.0)))


def scored_children(nodes: DataFrame, sections: DataFrame, small: Hint = search.bounded) -> DataFrame:
    """Children of sections with their section's score, CHILD_SCORE at least, the best section's first and in their order."""
    score = F.greatest(F.lit(CHILD_SCORE), search.evidence_score(F.lit(None).cast("double"), *map(F.col, (*SCORES, "fusion_score"))))
    below = nodes.select("node_id", *NODE).join(small(sections.select("query_id", F.col("node_id").alias("parent_id"), score.alias("fusion_score"))), "parent_id")
    order = W.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), "order_index", "node_id")
    return below.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("bucket", F.lit("section_child"))


def following_siblings(headings: DataFrame, nodes: DataFrame, limit: int, small: Hint = search.bounded) -> DataFrame:
    """Of each parent of headings(query_id, parent_id, order_index) the first `limit` children from the earliest heading on."""
    earliest = headings.filter("parent_id is not null").groupBy("query_id", "parent_id").agg(F.min(F.coalesce("order_index", F.lit(0).cast("long"))).alias("from"))
    after = nodes.select("node_id", *NODE).join(small(earliest), "parent_id").filter(F.coalesce("order_index", F.lit(0).cast("long")) >= F.col("from"))
    return trees.first_per(after, ["query_id", "parent_id"], ["order_index", "node_id"], limit).drop("place", "from").withColumn("bucket", F.lit("section_sibling"))


def merged_candidates(base: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """Both lists with each node once, the row of the better score (of equal ones that of base), by rerank, sparse, dense and fusion score."""
    scores = ["rerank_score", "sparse_score", "dense_score", "fusion_score"]
    full = lambda x, n: x.withColumns({s: F.lit(None).cast("double") for s in scores if s not in x.columns}).select("query_id", "node_id", "bucket", *NODE, *scores, F.lit(n).alias("list_no"))
    own = F.coalesce(*[F.nullif(F.col(s), F.lit(0.0)) for s in scores[1:]], F.lit(0.0))
    better = W.partitionBy("query_id", "node_id").orderBy(own.desc(), "list_no")
    once = full(base, 0).unionByName(full(more, 1)).withColumn("n", F.row_number().over(better)).filter("n = 1")
    order = W.partitionBy("query_id").orderBy(*[F.coalesce(s, F.lit(0.0)).desc() for s in scores], "list_no", "node_id")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).drop("n", "list_no")


def reranked(hits: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None, keep: int) -> DataFrame:
    """The best `keep` by rerank(hits), which adds rerank_score; without it, or where it gives null, the order stays."""
    scored = rerank(hits) if rerank else hits.withColumn("rerank_score", F.lit(None).cast("double"))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank", "node_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep)


def limited(hits: DataFrame, limit: int, budget: Budget, buckets: dict[str, int]) -> DataFrame:
    return selectors.capped(hits, limit, budget.per_source, buckets).drop("rank").withColumnRenamed("chosen", "rank")


def with_siblings(final: DataFrame, nodes: DataFrame, budget: Budget, small: Hint = search.bounded) -> DataFrame:
    """final and the leaves beside its first hits, each node once: query_id, node_id, document_id, level, order_index, origin, score.

    A sibling's score is its seed's rerank score times the decay; it stays what it was if it is in final itself.
    """
    own = final.select("query_id", "node_id", "document_id", "level", "order_index", F.lit("ranked").alias("origin"), search.evidence_score(*map(F.col, ("rerank_score", *SCORES, "fusion_score"))).alias("score"), F.lit(0).cast("long").alias("seed"))
    seeds = final.filter(F.col("rank") <= budget.seeds).select("query_id", "parent_id", F.col("rank").alias("seed"), (F.coalesce("rerank_score", F.lit(0.0)) * budget.decay).alias("score"))
    beside = nodes.filter("level = 0").select("node_id", "document_id", "parent_id", "level", "order_index").join(small(seeds), "parent_id")
    some = trees.first_per(beside, ["query_id", "seed"], ["order_index", "node_id"], budget.siblings).withColumn("origin", F.lit("sibling"))
    both = own.unionByName(some.select(own.columns))
    first = W.partitionBy("query_id", "node_id").orderBy("seed")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "seed")


def retrieve(questions: DataFrame, nodes: DataFrame, budget: Budget, vectors: tuple[DataFrame, DataFrame] | None = None, scope: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, narrative: bool = False) -> DataFrame:
    """questions(query_id, query) over nodes -> the context of each question; sort it by document_id, level, order_index to read it.

    Ordinary questions take the children of the sections found, narrative ones all leaves below
    them. Null texts have no words; nodes without a parent have no siblings; a question without
    words and vector gets no rows.
    """
    small = budget.hint(questions)
    sections = branch(questions, nodes.filter("level > 0"), budget, budget.summary, "summary", vectors, scope, small)
    leaves = branch(questions, nodes.filter("level = 0"), budget, budget.leaf, "leaf", vectors, scope, small)
    if narrative:
        order = W.partitionBy("query_id").orderBy(F.col("section_score").desc(), "document_id", "order_index", "node_id")
        pool = leaves_below(nodes, sections).withColumn("rank", F.row_number().over(order).cast("long")).withColumn("bucket", F.lit("section_leaf"))
        pool = pool.filter(F.col("rank") <= 4 * budget.fused())
        buckets = {"section_leaf": budget.leaf, "leaf": budget.leaf}
        candidates = fused_items([pool, leaves], 4 * budget.fused() + budget.leaf)
    else:
        below = children(nodes, sections, max(budget.leaf, 8), small).withColumn("bucket", F.lit("summary_child"))
        buckets = {"leaf": budget.leaf, "summary_child": budget.summary}
        candidates = settled(limited(fused_items([leaves, below], budget.fused()), max(budget.candidates, budget.leaf), budget, buckets))
    best = reranked(candidates, rerank, budget.kept)
    return with_siblings(settled(limited(best, budget.kept, budget, buckets)), nodes, budget, small)
