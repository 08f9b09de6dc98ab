"""Importance resampling towards a target: documents drawn by how much likelier the target makes their words.

Every run of 1 to `longest` words is a feature, hashed into BUCKETS buckets. Counts of both sides
give each bucket a gain, in one array that every task holds, so a document's weight is a look-up
per feature. With a Gumbel draw of its own added, the highest scores are a sample without
replacement. The k-th highest is found exactly by selecting one digit of the key (score, then
doc_id) after another: each pass counts rows by digit, and only those with the digits found so
far go on. So only rows that are drawn are ever sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged, in_small_batches
from lodestone.llm.wordbytes import blocks, texts_of

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bits of the key that are selected by one pass.
DIGIT_BITS = 12
#: Rows of the drawn that are ranked in one range.
RANGE_ROWS = 1 << 16
#: Bytes of a word up to which words are hashed side by side.
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices, byte by byte side by side; long ones each by themselves.

    The step's table is made of the CRCs of single bytes, with which it agrees by linearity.
    """
    lengths = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    going = np.flatnonzero(lengths <= LONG_WORD)
    for k in range(int(lengths[going].max(initial=0))):
        going = going[lengths[going] > k]
        old = crc[going]
        crc[going] = _CRC[(old ^ data[starts[going] + k]) & np.uint32(0xFF)] ^ (old >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc


def buckets_of(texts: list[bytes], longest: int) -> list[tuple[int, np.ndarray]]:
    """(words, buckets of all features) of each text, texts taken a block at a time."""
    found = []
    for a, b in blocks(texts):
        raw = _LOWER[np.frombuffer(b"\n".join([*texts[a:b], b""]), np.uint8)]
        inside = _INSIDE[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edges[0::2], edges[1::2]
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        first = np.searchsorted(starts, begin)
        if longest > 1:  # words one space apart, so that a run of words is a slice
            lengths = ends - starts
            close = np.cumsum(lengths + 1) - 1
            data = np.full(int(close[-1]) + 1 if len(close) else 0, 0x20, np.uint8)
            own = np.repeat(close - lengths - starts, lengths)
            at = np.flatnonzero(inside)
            data[at + own] = raw[at]
            starts, ends = close - lengths, close
        else:
            data = raw
        kinds = []
        for n in range(1, longest + 1):
            m = max(0, len(starts) - n + 1)
            kinds.append((crc32_of(data, starts[:m], ends[n - 1 : n - 1 + m]) % np.uint32(BUCKETS)).astype(np.uint16))
        for i in range(b - a):
            p, q = int(first[i]), int(first[i + 1])
            found.append((q - p, np.concatenate([kind[p : max(p, q - n)] for n, kind in enumerate(kinds)])))
    return found


def features(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, words, n_features, buckets (two bytes each) of every row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = buckets_of(texts_of(batch.column("text")), longest)
            columns = [batch.column("doc_id"), pa.array([w for w, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "words", "n_features", "buckets"])

    return in_small_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, words long, n_features long, buckets binary")


def counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs: a row a bucket and task is shuffled, a row a bucket goes to the driver."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), np.uint16), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    found = np.zeros(BUCKETS, np.int64)
    for row in in_small_batches(rows.select("buckets"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target is in each bucket, with one added to each count, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel draw that depends on seed and doc_id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, targets: DataFrame, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score of every row of docs."""
    own = Staged(features(docs, longest))
    aim = counts(features(targets.select(F.lit(0).alias("doc_id"), "text"), longest))
    table = docs.sparkSession.sparkContext.broadcast(gains(counts(own.df), aim))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            weights = [int(table.value[np.frombuffer(b, np.uint16)].sum()) // (len(b) // 2) if b else 0 for b in batch.column("buckets").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "words", "n_features")), pa.array(weights, pa.int64())], names=["doc_id", "words", "n_features", "weight"])

    rows = in_small_batches(own.df, run, f"doc_id {kind}, words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))


def kth_value(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th smallest value (from 1) of a column of longs, and how many are smaller.

    Digits of the distance from the least value are fixed from the first to the last; a pass
    counts the rows that agree with those fixed so far by their next digit.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    digits = max(1, -(-(high - low).bit_length() // DIGIT_BITS))
    found, below = low, 0
    for place in reversed(range(digits)):
        width = 1 << place * DIGIT_BITS
        inside = rows.filter(F.col(column).between(found, min(high, found + (width << DIGIT_BITS) - 1)))
        digit = F.expr(f"(cast({column} AS decimal(20, 0)) - {found}) div {width}")
        for value, n in sorted(inside.groupBy(digit.cast("int").alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if below + n >= k:
                found += value * width
                break
            below += n
    return found, below


def up_to_kth(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A condition true for the k smallest rows by keys (longs, not null), and for those that equal the k-th in all keys."""
    parts, equal = [], F.lit(True)
    for name in keys:
        value, below = kth_value(rows, name, k)
        parts.append(equal & (F.col(name) < value))
        equal = equal & (F.col(name) == value)
        rows, k = rows.filter(F.col(name) == value), k - below
    for part in parts:
        equal = equal | part
    return equal


def resample(docs: DataFrame, targets: DataFrame, longest: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (long, null if not drawn) of every row of docs(doc_id, text); targets has text.

    Of the N rows with at least least_words words floor(percent * N / 100) are drawn, the
    highest scores first, ties to the smaller doc_id (an integer; null ones come last). Null
    texts are empty, and rows without a feature weigh 0. Repeated rows count and are drawn each;
    where they meet the last place, as many of them are drawn as are left. Without targets the
    gains are those of an empty target. Other columns are ignored, an empty table gives an
    empty result.
    """
    keys = ["below", "no_id", "id"]
    rows = scored(docs, targets, longest, seed).withColumns({"may": F.col("words") >= least_words, "below": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))})
    held = Staged(rows)
    out = ["doc_id", "n_features", "weight", "score"]
    able = held.df.filter("may")
    k = percent * able.count() // 100
    if k == 0:
        return held.df.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = F.col("may") & up_to_kth(able.select(*keys), keys, k)
    by = [*keys, "weight", "n_features"]
    ranges = max(1, -(-k // RANGE_ROWS))
    cut = Staged(held.df.filter(drawn).repartitionByRange(ranges, *by).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = Staged(cut.df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("offset"))).for_join(16)
    place = F.row_number().over(W.partitionBy("part").orderBy(*by)) + F.col("offset")
    ranked = cut.df.join(offsets, "part").withColumn("place", place).select(*out, F.when(F.col("place") <= k, F.col("place")).alias("rank"))
    return ranked.unionByName(held.df.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
