"""A word index kept as postings: built and kept current batch by batch, and searched without reading texts.

A row is a term with the nodes that hold it among some hundreds or thousands written together,
and how often; rows without a term hold the nodes themselves and how many terms each has. Rows
are dealt by batch and by the term's hash. What the greatest batch says of a node is in force,
so writing a node again or deleting it only adds rows. A batch that is written twice, as streams
may, replaces itself.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import search

BUCKETS = 64
#: The bucket of rows without a term, and the length of a node that was deleted.
NODES = DELETED = -1
#: Bytes of texts whose postings a task holds at a time.
PART_BYTES = 4 << 20
#: Nodes that a row can hold.
ROW_NODES = 5000


def bucket_of(term: Column) -> Column:
    return F.when(term.isNull(), F.lit(NODES).cast("long")).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PART_BYTES of texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column("low")), 0).to_numpy(zero_copy_only=False)
    of = np.cumsum(sizes) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start or not len(of):
            yield batch.slice(start, end - start)


def inverted(docs: DataFrame, kind: str) -> DataFrame:
    """docs(node_id, low, live) -> (term, nodes, counts), each task's nodes some at a time."""

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            ids = batch.column("node_id")
            lengths, held = [], defaultdict(lambda: ([], []))
            for i, (text, live) in enumerate(zip(batch.column("low").to_pylist(), batch.column("live").to_pylist(), strict=True)):
                length, found = 0, Counter()
                for piece in search.pieces(text if live else ""):
                    own = search._TERM.findall(piece)
                    length += len(own)
                    found.update(own)
                lengths.append(length if live else DELETED)
                for term, n in found.items():
                    held[term][0].append(i)
                    held[term][1].append(n)
            terms, places, counts = [None], [range(len(ids))], [lengths]
            for term, (at, n) in held.items():
                terms.append(term)
                places.append(at)
                counts.append(n)
            offsets = pa.array([0, *(int(n) for n in _ends(places))], pa.int32())
            nodes = pa.ListArray.from_arrays(offsets, ids.take(pa.array([i for at in places for i in at], pa.int64())))
            yield pa.record_batch([pa.array(terms, pa.string()), nodes, pa.array(counts, pa.list_(pa.int64()))], names=["term", "nodes", "counts"])

    return docs.mapInArrow(run, f"term string, nodes array<{kind}>, counts array<long>")


def _ends(lists: list) -> list[int]:
    total, found = 0, []
    for x in lists:
        total += len(x)
        found.append(total)
    return found


class Index:
    """An index of nodes whose ids have the given SQL type."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def write(self, docs: DataFrame, batch: int) -> None:
        """docs(node_id, text, live boolean): nodes written, or deleted where live is false. Of a node's several rows in one batch the one of the greatest text counts.

        Batches are numbered upwards. Null texts are empty; null ids are left out. May be given to foreachBatch.
        """
        rows = docs.filter("node_id is not null").select(F.col("node_id").cast(self.kind).alias("node_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.coalesce("live", F.lit(True)).alias("live"))
        if not rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            greatest = W.partitionBy("node_id").orderBy(F.col("low").desc(), F.col("live").desc())
            rows = rows.withColumn("n", F.row_number().over(greatest)).filter("n = 1").drop("n")
        self._put(inverted(rows, self.kind), batch)

    def _put(self, rows: DataFrame, batch: int) -> None:
        dealt = rows.withColumn("bucket", bucket_of(F.col("term"))).hint("rebalance", "bucket").withColumn("batch", F.lit(batch).cast("long"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"term string, nodes array<{self.kind}>, counts array<long>, batch long, bucket long").parquet(self.path)

    def _postings(self, rows: DataFrame) -> DataFrame:
        return rows.select("term", "batch", F.explode(F.arrays_zip("nodes", "counts")).alias("x")).select("term", "batch", F.col("x.nodes").alias("node_id"), F.col("x.counts").alias("tf"))

    def nodes(self) -> DataFrame:
        """node_id, length, batch of the nodes in force."""
        said = self._postings(self._rows().filter(F.col("bucket") == NODES))
        last = said.groupBy("node_id").agg(F.max(F.struct("batch", F.col("tf").alias("length"))).alias("x"))
        return last.filter(F.col("x.length") != DELETED).select("node_id", "x.length", "x.batch")

    def search(self, queries: DataFrame, match_all: bool = False) -> DataFrame:
        """(query_id, node_id, score) of queries(query_id, query), as search.bm25 over the nodes in force; only the buckets of asked terms are read."""
        asked = search.asked_terms(queries)
        held = search.held_terms(asked)
        wanted = asked.select("term").distinct()
        buckets = [r[0] for r in wanted.select(bucket_of(F.col("term"))).distinct().collect()]
        nodes = self.nodes()
        rows = self._rows().filter(F.col("bucket").isin(buckets)).join(F.broadcast(wanted) if held is not None else wanted, "term", "left_semi")
        counted = self._postings(rows).join(nodes, ["node_id", "batch"]).select("node_id", "term", "tf", "length")
        frequency = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        corpus = nodes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
        return search.bm25_scores(counted, frequency, corpus, asked, match_all, held is not None)

    def rebuilt(self, path: str) -> Index:
        """The same nodes as one batch in another folder, without what isn't in force any more."""
        other = Index(self.spark, path, self.kind)
        nodes = self.nodes()
        kept = self._postings(self._rows().filter(F.col("bucket") != NODES)).join(nodes.select("node_id", "batch"), ["node_id", "batch"], "left_semi")
        every = kept.select("term", "node_id", "tf").unionByName(nodes.select(F.lit(None).cast("string").alias("term"), "node_id", F.col("length").alias("tf")))
        share = F.floor(F.monotonically_increasing_id() / ROW_NODES)
        rows = every.groupBy("term", share.alias("share")).agg(F.collect_list(F.struct("node_id", "tf")).alias("x"))
        other._put(rows.select("term", F.col("x")["node_id"].alias("nodes"), F.col("x")["tf"].alias("counts")), 0)
        return other
