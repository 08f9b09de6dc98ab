"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. The 64
bits form a ring of SEGMENTS segments. If two fingerprints differ in at most MAX_BITS bits,
there is a segment from which every chain of l consecutive segments differs in at most
l * MAX_BITS / SEGMENTS bits (the pigeonhole principle on a ring, in its strong form). With
16 segments and 2 bits the first seven must agree and the first fifteen differ in at most one
bit. So fingerprints meet in 16 tables keyed by seven consecutive segments, 28 bits, the chain's
budget prunes pairs, and the full Hamming distance decides.

Only distinct fingerprints meet, so copies make no pairs. Where more than PAIRWISE of them
share a key, pairs would grow with the square; there the links come from meeting points: two
fingerprints differ in at most 2 bits exactly if they share a value at most 1 bit away from
each, so each lists its 65 values and joins the least fingerprint at each value. Both ways are
exact. A key with more than SPREAD fingerprints does the same as a distributed aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.staging import Staged, in_small_batches, without_repeats
from lodestone.llm.wordbytes import blocks, texts_of

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 16
SEGMENT_BITS = 64 // SEGMENTS
#: Leading segments of a chain whose budget is below one bit.
AGREEING = -(-SEGMENTS // MAX_BITS) - 1
KEY_BITS = AGREEING * SEGMENT_BITS
PAIRWISE = 64
SPREAD = 1 << 20
#: Rows of the tables that one task links.
TASK_ROWS = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UNPACK_ROWS = 1 << 16
#: Bytes of a text of which shingles are made at a time.
PART_BYTES = 1 << 17


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, some words at a time."""
    digest = xxhash.xxh64_intdigest
    words, done = [], False
    for part in _parts(text):
        words += part.translate(_LOWER).split()
        if len(words) < SHINGLE:
            continue
        done = True
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts[SHINGLE - 1 :] + lengths[SHINGLE - 1 :]
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64)
        words = words[-(SHINGLE - 1) :] if SHINGLE > 1 else []
    if words and not done:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PART_BYTES that end where a word does."""
    a = 0
    while a < len(text):
        end = _SPACE.search(text, a + PART_BYTES)
        b = end.start() if end else len(text)
        yield text[a:b]
        a = b


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Unsigned fingerprints; zero for a text without words."""
    ones = np.zeros((len(texts), 64), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    rows = 0

    def flush() -> None:
        nonlocal rows
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.cumsum([0, *map(len, held)])[:-1]
            np.add.at(ones, owners, np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        held.clear()
        owners.clear()
        rows = 0

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text):
            sizes[i] += len(hashes)
            for k in range(0, len(hashes), _UNPACK_ROWS):
                held.append(hashes[k : k + _UNPACK_ROWS])
                owners.append(i)
                rows += len(held[-1])
                if rows >= _UNPACK_ROWS:
                    flush()
    flush()
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row; null texts have no words."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            found = [fingerprints(texts[a:b]) for a, b in blocks(texts)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def tables(distinct: DataFrame) -> DataFrame:
    """(at, key, fp): the fingerprint in each of the ring's tables, by the agreeing segments that begin there."""
    ring = [f"(shiftleft(fp, {i * SEGMENT_BITS}) | shiftrightunsigned(fp, {64 - i * SEGMENT_BITS}))" if i else "fp" for i in range(SEGMENTS)]
    keys = [f"struct({i} AS at, shiftrightunsigned({turned}, {64 - KEY_BITS}) AS key)" for i, turned in enumerate(ring)]
    return distinct.select("fp", F.expr(f"explode(array({', '.join(keys)})) AS t")).select("t.at", "t.key", "fp")


def _ball(fp: np.ndarray) -> np.ndarray:
    return np.concatenate([fp[:, None], fp[:, None] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))], axis=1)


def chain_allows(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the chain from segment `at` of the differing bits keeps within its budget at every length."""
    apart = left ^ right
    turn = (at * SEGMENT_BITS).astype(np.uint64)
    turned = (apart << turn) | np.where(turn > 0, apart >> ((np.uint64(64) - turn) & np.uint64(63)), 0)
    allowed = np.ones(len(apart), bool)
    for length in range(1, SEGMENTS + 1):
        differing = np.bitwise_count(turned >> np.uint64(64 - length * SEGMENT_BITS))
        allowed &= differing <= length * MAX_BITS // SEGMENTS
    return allowed


def local_links(at: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root): what is linked under one key, each fingerprint with the least one reached, itself left out."""
    order = np.lexsort((fp, key, at))
    at, key, fp = at[order], key[order], fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group] if len(fp) else group
    a, b = [], []
    few = np.flatnonzero((size > 1) & (size <= PAIRWISE))
    for step in range(1, PAIRWISE):
        few = few[few + step < len(fp)]
        few = few[group[few] == group[few + step]]
        if not len(few):
            break
        left, right = fp[few], fp[few + step]
        near = chain_allows(left, right, at[few])
        near[near] = np.bitwise_count(left[near] ^ right[near]) <= MAX_BITS
        a.append(left[near])
        b.append(right[near])
    for g in np.unique(group[size > PAIRWISE]):
        members = fp[np.searchsorted(group, g) : np.searchsorted(group, g, "right")]
        for k in range(0, len(members), 1 << 14):
            points = _ball(members[k : k + (1 << 14)])
            a.append(points.ravel())
            b.append(np.repeat(members[k : k + (1 << 14)], points.shape[1]))
    if not a:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(a), np.concatenate(b), fp)


def _forest(a: np.ndarray, b: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least member reached from each, by repeated minima over the links and jumps to the minimum's minimum."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    real = np.isin(nodes, members)
    label = np.where(real, np.arange(len(nodes)), len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, label[x])
        inside = label < len(nodes)
        label[inside] = label[label[inside]]
        if (label == before).all():
            break
    moved = real & (label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly what pairs at most MAX_BITS apart connect; about as many as fingerprints."""
    spark = distinct.sparkSession
    keyed = Staged(tables(distinct))
    heavy = Staged(keyed.df.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPREAD).select("at", "key"))
    some = heavy.rows() > 0
    rows = keyed.df.join(heavy.for_join(24), ["at", "key"], "left_anti") if some else keyed.df

    def run(batches):
        batches = list(batches)
        if batches:
            at, key, fp = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("at", "key", "fp"))
            a, b = local_links(at, key, fp.astype(np.int64).view(np.uint64))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    tasks = max(1, -(-keyed.rows() // TASK_ROWS))
    found = rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("at"), F.col("key")).mapInArrow(run, "a long, b long")
    if some:
        ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
        points = keyed.df.join(heavy.for_join(24), ["at", "key"], "left_semi").select("fp").distinct().select("fp", F.explode(ball).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("b"))
        found = found.unionByName(points.join(least, "point").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct())
    return found


def classes(prints: DataFrame) -> Staged:
    """(fp, component_id, first): every distinct fingerprint of prints(doc_id, fp), the least doc_id its links reach, and the least fingerprint that has it."""
    distinct = Staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = components(links(distinct.df))
    rooted = distinct.df.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "fp")
    ids = rooted.groupBy("root").agg(F.min(of).alias("of")).select("root", F.col("of.doc_id").alias("component_id"), F.col("of.fp").alias("first"))
    found = Staged(rooted.join(ids, "root").select("fp", "component_id", "first"))
    distinct.drop()
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Texts of fewer than SHINGLE words have one shingle, those without words (null and empty
    ones) the fingerprint zero, which links like any other. Rows that repeat a doc_id or a text
    are all returned; null doc_ids are returned and are a component's id only if nothing else
    is in it. Other columns are ignored, an empty table gives an empty result.
    """
    prints = Staged(fingerprint_rows(docs))
    joined = prints.df.join(classes(prints.df).df, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near duplicates, all columns: that of the smallest doc_id (null ones last).

    A row is known by its doc_id, text and fingerprint: of rows that share the smallest doc_id
    the one of the least fingerprint stays, of rows that repeat all three the one of the least
    hash over all columns. Null and empty texts are one group. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [fingerprints(texts_of(batch.column("text")))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("__row"), pa.array(found[0].view(np.int64))], names=["doc_id", "__row", "fp"])

    marked = docs.withColumn("__row", F.xxhash64(*docs.columns))
    prints = Staged(in_small_batches(marked.select("doc_id", "__row", "text"), run, f"doc_id {kind}, __row long, fp long"))
    stands = classes(prints.df)
    first = prints.df.join(stands.df.filter("fp = first"), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = first.groupBy("first").agg(F.min("__row").alias("__row"), F.first("doc_id").alias("doc_id")).select(F.col("doc_id").alias("__stays"), F.col("__row").alias("__stays_row"))
    met = marked.join(stays, F.col("doc_id").eqNullSafe(F.col("__stays")) & (F.col("__row") == F.col("__stays_row")), "left_semi")
    return without_repeats(met, ["doc_id", "__row"]).drop("__row")
