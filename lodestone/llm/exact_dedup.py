"""Exact dedup by an extendible-hash index kept as shared files. DataFrame operations only.

The index of a set of texts is what inserting them one by one leaves behind: a directory of
2^depth slots over the leading bits of a 64-bit key, buckets that were split (doubling the
directory where needed) as long as they held more than `capacity` entries, and in each bucket
a chain of entries for every key. That end state depends on the keys alone, so it is computed
in four steps instead of by insertion:

* keys: every text is read once for its key and digest; only these travel;
* entries: a key that one document has is an entry as it is. Where a key repeats the texts
  themselves are grouped by (key, bytes), with combination before the shuffle, so a text copied
  a billion times reaches its reducer once per map task, and texts that merely share a key stay
  apart because their bytes are compared;
* directory: counts by key prefix are rolled up over all depths; a prefix is a bucket if it
  fits while its parent overflowed, and it is the target of 2^(depth - its own depth) slots;
* buckets: entries are range-partitioned by (bucket, key), so each owner task writes one key
  range, and get their place in their key's chain.

A document finds its entry through the directory: the leading bits of its key name a slot, the
slot a bucket, and in the bucket the key a chain, along which digests are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged, without_repeats

#: Entries per bucket; a bucket is one owner's unit of work, about 8 MB.
BUCKET_CAPACITY = 1 << 17
#: Depths beyond the average one at which a bucket may still split; deeper ones chain.
EXTRA_DEPTH = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash_key(norm: Column, key_bits: int = 64) -> Column:
    """The leading key_bits of the XXH64 of the text, as the leading bits of a long."""
    return F.xxhash64(norm) if key_bits == 64 else F.shiftleft(F.xxhash64(norm), 64 - key_bits)


def prefix(key: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


@dataclass
class ExtendibleIndex:
    """`slots`: slot, bucket. `buckets`: bucket, key, position and length of the chain, keep_id, group_size, text_sha256.

    `keyed` has doc_id, key and text_sha256 of the indexed rows.
    """

    keyed: Staged
    slots: Staged
    buckets: Staged
    depth: int
    key_bits: int


def keys_of(docs: DataFrame, key_bits: int) -> DataFrame:
    """doc_id, key and text_sha256 of docs(doc_id, text)."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return rows.select("doc_id", hash_key(F.col("norm"), key_bits).alias("key"), F.sha2("norm", 256).alias("text_sha256"))


def build_index(docs: DataFrame, capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> ExtendibleIndex:
    """Index of the texts of docs(doc_id, text); null texts count as empty, an empty table gives an empty index."""
    keyed = Staged(keys_of(docs, key_bits))
    of_key = Staged(keyed.df.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("text_sha256").alias("text_sha256")))
    repeated = Staged(of_key.df.filter("group_size > 1").select("key"))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("key", hash_key(F.col("norm"), key_bits))
    compared = (
        texts.join(repeated.for_join(16), "key", "left_semi")
        .groupBy("key", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    )
    entries = Staged(of_key.df.filter("group_size = 1").select("key", "keep_id", "group_size", "text_sha256").unionByName(compared))
    deepest = min(key_bits, max(0, math.ceil(math.log2(max(1, entries.rows() / capacity)))) + EXTRA_DEPTH)
    directory = _directory(entries.df, capacity, deepest)
    depth = directory.df.agg(F.max("depth")).first()[0] or 0
    span = F.expr(f"shiftleft(1L, {depth} - depth)")
    bucket = (F.col("prefix") * span).alias("bucket")
    slots = Staged(directory.df.select(bucket, F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1)).alias("slot")))
    in_chain = W.partitionBy("bucket", "key")
    buckets = Staged(
        entries.df.withColumn("slot", prefix(F.col("key"), depth))
        .join(slots.for_join(24), "slot")
        .drop("slot")
        .repartitionByRange("bucket", "key")
        .withColumn("position", F.row_number().over(in_chain.orderBy("keep_id", "text_sha256")))
        .withColumn("chain", F.count(F.lit(1)).over(in_chain))
    )
    for old in (of_key, repeated, entries, directory):
        old.drop()
    return ExtendibleIndex(keyed, slots, buckets, depth, key_bits)


def _directory(entries: DataFrame, capacity: int, deepest: int) -> Staged:
    """(depth, prefix) of every bucket: it fits or is at the deepest level, and its parent overflowed."""
    finest = entries.groupBy(prefix(F.col("key"), deepest).alias("finest")).agg(F.count(F.lit(1)).alias("n"))
    levels = (
        finest.select("finest", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
        .withColumn("prefix", F.expr(f"shiftrightunsigned(finest, {deepest} - depth)"))
        .groupBy("depth", "prefix")
        .agg(F.sum("n").alias("n"))
    )
    overflowed = levels.filter(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = levels.filter((F.col("n") <= capacity) | (F.col("depth") == deepest)).withColumn("parent", F.shiftright("prefix", 1))
    below = fits.filter("depth > 0").join(overflowed, ["depth", "parent"], "left_semi")
    return Staged(fits.filter("depth = 0").unionByName(below).select("depth", "prefix"))


def look_up(keyed: DataFrame, index: ExtendibleIndex) -> DataFrame:
    """What the index holds of keyed(doc_id, key, text_sha256): doc_id, keep_id, group_size, kept, text_sha256."""
    routed = keyed.withColumn("slot", prefix(F.col("key"), index.depth)).join(index.slots.for_join(24), "slot")
    found = routed.join(index.buckets.df.select("bucket", "key", "text_sha256", "keep_id", "group_size"), ["bucket", "key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per row of docs: which document of its group of equal texts stays.

    Of equal texts the smallest doc_id stays. Null texts equal empty ones. A row repeated with
    its doc_id counts in group_size and shares its verdict, since rows are known by doc_id
    alone; null doc_ids stay only where no row of the group has one. Columns other than
    doc_id and text are ignored, an empty table gives an empty result.
    """
    index = build_index(docs, capacity, key_bits)
    return look_up(index.keyed.df, index)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns. A row is known by its doc_id (null ones included) and text.

    Rows that repeat both stay once, that of the least hash over all columns; rows that share a
    doc_id but not a text are judged apart.
    """
    stays = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__stays"), F.col("text_sha256").alias("__stays_sha")).distinct()
    known = without_repeats(docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256)), ["doc_id", "__sha"])
    same = F.col("doc_id").eqNullSafe(F.col("__stays")) & (F.col("__sha") == F.col("__stays_sha"))
    return known.join(stays, same, "left_semi").drop("__sha")
