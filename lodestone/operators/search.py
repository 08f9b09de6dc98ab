"""Retrieval: exact cosine top-k, BM25, reciprocal-rank fusion, and limits that keep results diverse."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import settled

RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
#: The most a side that is broadcast may hold.
BROADCAST_BYTES = 16 << 20
#: Scores that a task holds at a time.
SCORES = 1 << 21
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20

_TERM = re.compile("[a-z0-9]+")
_GAP = re.compile("[^a-z0-9]")


def row_bytes(df: DataFrame) -> int:
    """About what all rows hold, as JSON text; a pass over them."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def bounded(queries: DataFrame) -> DataFrame:
    """queries with a broadcast hint if their bytes fit BROADCAST_BYTES; else Spark picks how to join them."""
    return F.broadcast(queries) if row_bytes(queries) <= BROADCAST_BYTES else queries


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def ranked(hits: DataFrame, score: str, ties: str, by: list[str], limit: int | None = None) -> DataFrame:
    """hits with `rank` from 1, the best score first; with a limit only so many a group, which Spark pushes below the shuffle."""
    order = W.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(ties))
    hits = hits.withColumn("rank", F.row_number().over(order).cast("long"))
    return hits if limit is None else hits.filter(F.col("rank") <= limit)


def unit_vectors(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors that have this size, no nulls and a length other than 0, scaled to length 1."""
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
    places = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    values = vectors.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    lengths = np.sqrt((values**2).sum(1))
    good = lengths > 0
    return places[good], values[good] / lengths[good, None]


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries in tables of about BROADCAST_BYTES, one at a time in the driver."""
    total = row_bytes(queries)
    parts = -(-total // BROADCAST_BYTES)
    for k in range(parts):
        some = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        yield some.toArrow()


def _nearest(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Places of the greatest scores, ties to the smaller id."""
    if len(scores) > limit:
        least = np.partition(scores, -limit)[-limit]
        over, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        return np.concatenate([over, tied[np.argsort(ids[tied], kind="stable")][: limit - len(over)]])
    return np.arange(len(scores))


def dense_topk(queries: DataFrame, rows: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """queries(query_id, query_vector, ...) x rows(node_id, vector, ...) -> the `limit` nearest rows of each query.

    Queries are held as one matrix a block, which every task multiplies with its rows batch by
    batch, SCORES products at a time; `limit` rows of each query leave a batch. Vectors that are null, hold a null, have
    length 0 or another size than the query's are no hits.
    """
    if where is not None:
        rows = rows.filter(where)
    carried = [f for f in rows.schema.fields if f.name != "vector"]
    own = [f for f in queries.schema.fields if f.name != "query_vector"]
    schema = T.StructType([*carried, *own, T.StructField("score", T.DoubleType())])

    def scored(block: pa.Table) -> DataFrame:
        vectors = block.column("query_vector").combine_chunks()
        sizes = {n for n in pc.list_value_length(vectors).to_pylist() if n}
        held = [(size, *unit_vectors(vectors, size)) for size in sorted(sizes)]
        names = block.drop_columns(["query_vector"])
        sent = rows.sparkSession.sparkContext.broadcast((held, names))

        def run(batches):
            parts, names = sent.value
            for batch in batches:
                ids = batch.column("node_id").to_numpy(zero_copy_only=False)
                for size, asked, matrix in parts:
                    places, unit = unit_vectors(batch.column("vector"), size)
                    step = max(1, SCORES // max(1, len(unit)))
                    for first in range(0, len(asked), step):
                        products = np.round(unit @ matrix[first : first + step].T, 6) + 0.0
                        some = asked[first : first + step]
                        found = [_nearest(products[:, k], ids[places], limit) for k in range(len(some))]
                        at = np.concatenate([np.zeros(0, np.int64), *found])
                        of = np.repeat(np.arange(len(some)), [len(f) for f in found])
                        hits = batch.take(pa.array(places[at]))
                        queries_of = names.take(pa.array(some[of])).combine_chunks()
                        columns = [hits.column(f.name) for f in carried] + [queries_of.column(f.name).combine_chunks() for f in own]
                        yield pa.record_batch([*columns, pa.array(products[at, of])], names=schema.names)

        return rows.mapInArrow(run, schema)

    found = [scored(block) for block in _blocks(queries)]
    empty = rows.sparkSession.createDataFrame([], schema)
    return ranked(reduce(DataFrame.unionByName, found) if found else empty, "score", "node_id", ["query_id"], limit)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """docs(node_id, text) -> (node_id, term, tf, length)."""
    words = docs.select("node_id", terms(F.col("text")).alias("words"))
    return words.select("node_id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("node_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes in fewer parts than there are; such a table is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def counted_terms(docs: DataFrame, asked: frozenset[str]) -> DataFrame:
    """(node_id, term, tf, length) of the asked terms in docs(node_id, text), and for each task a row of null term with its documents in tf and their terms in length.

    One pass over the texts: only what is asked for leaves a task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(asked)
    kind = docs.schema["node_id"].dataType.simpleString()

    def run(batches):
        documents = words = 0
        node_type = None
        for batch in batches:
            node_type = batch.column("node_id").type
            nodes, found, counts, lengths = [], [], [], []
            for i, text in enumerate(batch.column("low").to_pylist()):
                length, held = 0, Counter()
                for piece in pieces(text or ""):
                    own = _TERM.findall(piece)
                    length += len(own)
                    held.update(filter(sent.value.__contains__, own))
                documents, words = documents + 1, words + length
                nodes += [i] * len(held)
                found += held
                counts += held.values()
                lengths += [length] * len(held)
            yield pa.record_batch([batch.column("node_id").take(pa.array(nodes, pa.int64())), pa.array(found, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], names=["node_id", "term", "tf", "length"])
        if documents:
            yield pa.record_batch([pa.nulls(1, node_type), pa.nulls(1, pa.string()), pa.array([documents]), pa.array([words])], names=["node_id", "term", "tf", "length"])

    return spread(docs.select("node_id", F.lower("text").alias("low"))).mapInArrow(run, f"node_id {kind}, term string, tf long, length long")


def bm25_scores(counted: DataFrame, frequency: DataFrame, corpus: DataFrame, asked: DataFrame, match_all: bool, few: bool) -> DataFrame:
    """(query_id, node_id, score) from counted(node_id, term, tf, length), frequency(term, df), corpus of one row (n, mean_length) and asked(query_id, term).

    few says that asked fits BROADCAST_BYTES; then a word in a third of all rows is joined where its rows are.
    """
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean_length")))
    weighed = frequency.join(asked, "term")
    joined = counted.join(F.broadcast(weighed) if few else weighed, "term").crossJoin(F.broadcast(corpus))
    scores = joined.groupBy("query_id", "node_id").agg(F.round(F.sum(idf * weight), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    if match_all:
        scores = scores.join(sizes, "query_id").filter("matched = n_terms").drop("n_terms")
    return scores.drop("matched")


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def held_terms(asked: DataFrame) -> frozenset[str] | None:
    """The terms of asked(query_id, term), if its rows fit BROADCAST_BYTES."""
    held, size = set(), 0
    for row in asked.toLocalIterator():
        held.add(row["term"])
        size += 64 + len(row["term"])
        if size > BROADCAST_BYTES:
            return None
    return frozenset(held)


def bm25(queries: DataFrame, docs: DataFrame, match_all: bool = False) -> DataFrame:
    """queries(query_id, query) against docs(node_id, text): (query_id, node_id, score) of all documents with a term.

    match_all asks for every distinct term of the query. Document frequencies and lengths come
    from all of docs, null texts being empty ones. node_id tells documents apart. The asked terms go to every task while they
    fit BROADCAST_BYTES; more are joined with all postings. An index of stored postings
    (operators/postings.py) answers without reading texts.
    """
    asked = asked_terms(queries)
    held = held_terms(asked)
    if held is not None:
        found = settled(counted_terms(docs, held))
        corpus = found.filter("term is null").agg(F.sum("tf").alias("n"), (F.sum("length") / F.sum("tf")).alias("mean_length"))
        counted = found.filter("term is not null")
    else:
        every = postings(docs)
        corpus = docs.select(F.size(terms(F.coalesce("text", F.lit("")))).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
        counted = every.join(asked.select("term").distinct(), "term", "left_semi")
    frequency = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return bm25_scores(counted, frequency, corpus, asked, match_all, held is not None)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """lists of (query_id, node_id, rank) -> (query_id, node_id, fusion_score, first_seen): sums of 1 / (k + rank).

    A node twice in a list counts twice. first_seen orders ties by where a node first appears,
    list after list.
    """
    numbered = [x.select("query_id", "node_id", "rank", F.lit(i).alias("list_no")) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, numbered)
    return both.groupBy("query_id", "node_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("fusion_score"), F.min(F.struct("list_no", "rank")).alias("first_seen"))


def fused(lists: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), "first_seen", "node_id")
    found = rrf(lists, k).withColumn("fusion_score", F.round("fusion_score", 9)).withColumn("rank", F.row_number().over(order).cast("long"))
    return found.filter(F.col("rank") <= limit).drop("first_seen")


def source_limit(hits: DataFrame, limit: int, cap: int, by: list[str], source: str = "source") -> DataFrame:
    """At most `limit` hits a group in three passes: up to `cap` of each source, then up to min(limit, 2 cap), then any.

    hits has `rank`; the passes' own order is kept, so `rank` is renumbered.
    """
    soft = max(cap, min(limit, 2 * cap))
    place = F.row_number().over(W.partitionBy(*by, source).orderBy("rank"))
    at = F.when(place <= cap, 1).when(place <= soft, 2).otherwise(3)
    order = W.partitionBy(*by).orderBy("pass", "rank")
    passed = hits.withColumn("pass", at).withColumn("place", F.row_number().over(order).cast("long"))
    return passed.filter(F.col("place") <= limit).drop("rank").withColumnRenamed("place", "rank")


def backfilled(hits: DataFrame, matched: Column, limit: int, by: list[str]) -> DataFrame:
    """Matched hits first, by score, then others up to the limit."""
    order = W.partitionBy(*by).orderBy(matched.desc(), F.col("score").desc_nulls_last(), "node_id")
    return hits.withColumn("matched", matched).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def best_of(lists: list[DataFrame], by: list[str]) -> DataFrame:
    """Union of hits, of each node the row of the best score."""
    order = W.partitionBy(*by, "node_id").orderBy(F.col("score").desc_nulls_last())
    return reduce(DataFrame.unionByName, lists).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def evidence_score(rerank: Column, dense: Column, sparse: Column, fusion: Column) -> Column:
    """Rerank score, else the better of dense and sparse, else fusion; zero counts as missing."""
    return F.coalesce(rerank, F.nullif(F.greatest(F.coalesce(dense, F.lit(0.0)), F.coalesce(sparse, F.lit(0.0))), F.lit(0.0)), fusion, F.lit(0.0))
