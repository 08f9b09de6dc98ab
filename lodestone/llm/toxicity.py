"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams (with marks at both ends), hashed into BUCKETS rows of an
embedding table; a text is the mean of its words, a word the mean of its n-grams; a linear
softmax over the mean gives the two classes. Table and softmax are trained together on a bounded
sample of labelled rows, read whole. N-grams whose share of texts doesn't differ between the
classes, by a likelihood-ratio test, keep the zero vector, so the table doesn't learn its sample
by heart. A misspelling or an inflection never seen shares most of its n-grams with words that were.

The sample stays in the cluster: the driver gets sketches of its texts, n-gram counts added up,
and of every text only the n-grams that have an embedding.

With two classes a text's logit is the mean over its words of a number each, so scoring finds
each distinct word of a block once and needs one number per bucket: 1 MB, however large the
corpus is. Texts are read a block, n-grams a slice at a time, so a long text or word costs no
more than its own bytes a few times over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged, in_small_batches
from lodestone.llm.wordbytes import blocks, boundaries, finish, texts_of, windows, word_hashes

THRESHOLD = 0.7
BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6)
SIZE = 8
#: Bound of the training sample: so many labelled rows of each class, those of least md5 of doc_id.
TRAIN_ROWS = 4000
#: Files of the sample, and so many sums of n-gram counts that the driver adds up.
SAMPLE_PARTS = 8
STEPS = 1500
BATCH = 128
RATE = 50.0
#: Likelihood ratio (chi-square, 1 degree) from which an n-gram tells the classes apart: two of BUCKETS do by chance.
TELLING = 20.0
SKETCH = 16
SEED = 7
#: Bytes of words of which n-grams are made at a time.
GRAM_BYTES = 1 << 16


@dataclass
class Model:
    table: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def per_bucket(self) -> np.ndarray:
        return (self.table @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def lowered(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts in lower case, as training and scoring both read them."""
    return texts_of(pc.utf8_lower(column))


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and the starts and ends of distinct words, the distinct word at each word's place, and each text's first place."""
    data, starts, ends, first = boundaries(texts)
    _, where, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return data, starts[where], ends[where], inverse, first


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of every n-gram of the words, a slice and a length at a time; a mark stands before and behind each word."""
    lengths = ends - starts + 2
    end = np.cumsum(lengths)
    total = int(lengths.sum())
    for p in range(0, total, GRAM_BYTES):
        q = min(p + GRAM_BYTES + GRAMS[-1] - 1, total)
        at = np.arange(p, q)
        owner = np.searchsorted(end, at, "right")
        offset = at - end[owner] + lengths[owner]
        marked = data[np.clip(offset + starts[owner] - 1, 0, len(data) - 1)].astype(np.uint64)
        marked[offset == 0] = 1
        marked[offset == lengths[owner] - 1] = 2
        last = end[owner]
        for n in GRAMS:
            m = min(GRAM_BYTES, q - p - n + 1)
            if m <= 0:
                continue
            inside = np.flatnonzero(at[:m] + n <= last[:m])
            code = np.zeros(len(inside), np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | marked[inside + k]
            yield (finish(code + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64), owner[inside]


def sketch(text: bytes) -> np.ndarray:
    """The SKETCH least hashes of a text's windows of 3 words."""
    data, starts, ends, _ = boundaries([text])
    return np.unique(windows(word_hashes(data, starts, ends), max(1, min(3, len(starts)))))[:SKETCH]


def distinct_rows(sketches: list[list[int]]) -> list[int]:
    """Places of sketches that aren't empty and share less than half their hashes with any kept before, so copies don't vote for their words."""
    kept, holders = [], {}
    for i, own in enumerate(sketches):
        met = Counter(j for v in own for j in holders.get(v, ()))
        if own and (not met or 2 * max(met.values()) < len(own)):
            kept.append(i)
            for v in own:
                holders.setdefault(v, []).append(i)
    return kept


def buckets_of(text: bytes) -> np.ndarray:
    """The distinct buckets of a text's n-grams."""
    data, starts, ends, _, _ = distinct_words([text])
    held = np.zeros(BUCKETS, bool)
    for bucket, _ in grams(data, starts, ends):
        held[bucket] = True
    return np.flatnonzero(held)


def telling(held: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The buckets whose share of texts differs between the classes by more than TELLING; held[class, bucket] and texts[class] are counts."""
    n = texts.sum()
    ratio = np.zeros(held.shape[1])
    for counts, of in ((held, held.sum(0)), (texts[:, None] - held, n - held.sum(0))):
        expected = np.maximum(of * texts[:, None] / n, 1e-300)
        ratio += 2 * np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-300) / expected), 0).sum(0)
    return np.flatnonzero(ratio > TELLING)


def bag(text: bytes, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, weight): how much of a text's mean is each n-gram that has a column (others -1)."""
    data, starts, ends, place, _ = distinct_words([text])
    n = np.zeros(len(starts))
    found = []
    for bucket, word in grams(data, starts, ends):
        n += np.bincount(word, minlength=len(starts))
        has = column[bucket] >= 0
        found.append((column[bucket[has]], word[has]))
    columns, words = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (zip(*found, strict=True) if found else ((), ())))
    each = np.bincount(place, minlength=len(starts)) / max(1, len(place)) / np.maximum(n, 1)
    used, where = np.unique(columns, return_inverse=True)
    return used, np.bincount(where, each[words], len(used))


def fit(columns: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, used: np.ndarray) -> Model:
    """Table and softmax by joint steps of adaptive gradients over the texts' bags; both classes must be there."""
    first = np.cumsum([0, *map(len, columns)])
    at, weight = np.concatenate(columns).astype(np.int64), np.concatenate(weights)
    rng = np.random.default_rng(SEED)
    table, softmax, bias = rng.uniform(-1 / SIZE, 1 / SIZE, (len(used), SIZE)), rng.uniform(-1, 1, (SIZE, 2)), np.zeros(2)
    seen = [np.full_like(v, 1e-8) for v in (table, softmax, bias)]
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    quota = (BATCH - BATCH // 4, BATCH // 4)
    for step in range(STEPS):
        some = np.concatenate([rng.choice(c, q) for c, q in zip(classes, quota, strict=True)])
        cells = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
        line = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
        rows, where = np.unique(at[cells], return_inverse=True)
        share = np.bincount(line * len(rows) + where, weight[cells], len(some) * len(rows)).reshape(len(some), len(rows))
        mean = share @ table[rows]
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(some)), labels[some]] -= 1
        p /= len(some)
        d_table, d_softmax = share.T @ (p @ softmax.T), mean.T @ p
        rate = 1 - step / STEPS
        seen[0][rows] += d_table**2
        table[rows] -= RATE * rate * d_table / np.sqrt(seen[0][rows])
        for value, slope, squares in ((softmax, d_softmax, seen[1]), (bias, p.sum(0), seen[2])):
            squares += slope**2
            value -= 0.05 * rate * slope / np.sqrt(squares)
    whole = np.zeros((BUCKETS, SIZE), np.float32)
    whole[used] = table
    return Model(whole, softmax, bias)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def sample(docs: DataFrame, labels: DataFrame) -> Staged:
    """(row, toxic, text) of the training rows: labelled alike by all their labels, not held out, bounded as said at TRAIN_ROWS."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(remainder(F.col("doc_id")) != 1)
    agreed = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    by = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = Staged(agreed.filter("toxic = 0").orderBy(*by).limit(TRAIN_ROWS).unionByName(agreed.filter("toxic = 1").orderBy(*by).limit(TRAIN_ROWS)).select("doc_id", "toxic"))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen.df), "doc_id")
    once = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    held = Staged(once.select(F.concat(*[F.md5(F.col("doc_id").cast("string")), F.lit("-"), F.col("doc_id").cast("string")]).alias("row"), F.col("toxic").cast("int").alias("toxic"), "text").repartition(SAMPLE_PARTS, "row"))
    chosen.drop()
    return held


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None if a class is missing. Only n-grams that tell the classes apart get an embedding other than 0."""
    spark, held = docs.sparkSession, sample(docs, labels)

    def sketches(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("row"), batch.column("toxic"), pa.array([sketch(t).astype(np.int64).tolist() for t in lowered(batch.column("text"))], pa.list_(pa.int64()))], names=["row", "toxic", "sketch"])

    known = sorted(in_small_batches(held.df, sketches, "row string, toxic int, sketch array<long>").collect())
    kept = {known[i]["row"]: i for i in distinct_rows([r["sketch"] for r in known])}
    texts = np.bincount([known[i]["toxic"] for i in kept.values()], minlength=2)
    if not texts.all():
        held.drop()
        return None
    rows = spark.sparkContext.broadcast(kept)

    def of_kept(batch) -> Iterator[tuple[str, int, bytes]]:
        mine = [r in rows.value for r in batch.column("row").to_pylist()]
        batch = batch.filter(pa.array(mine, pa.bool_()))
        yield from zip(batch.column("row").to_pylist(), batch.column("toxic").to_pylist(), lowered(batch.column("text")), strict=True)

    def counts(batches):
        held_by = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for _, label, text in of_kept(batch):
                held_by[label, buckets_of(text)] += 1
        yield pa.record_batch([pa.array([held_by.tobytes()], pa.binary())], names=["held"])

    total = np.zeros((2, BUCKETS), np.int64)
    for part in in_small_batches(held.df.coalesce(SAMPLE_PARTS), counts, "held binary").toLocalIterator():
        total += np.frombuffer(part["held"], np.int32).reshape(2, BUCKETS)
    used = telling(total, texts)
    column = np.full(BUCKETS, -1)
    column[used] = np.arange(len(used))
    columns = spark.sparkContext.broadcast(column)

    def bags(batches):
        for batch in batches:
            found = [(row, *bag(text, columns.value)) for row, _, text in of_kept(batch)]
            yield pa.record_batch([pa.array([r for r, _, _ in found], pa.string()), pa.array([c.astype(np.int32).tobytes() for _, c, _ in found], pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, _, w in found], pa.binary())], names=["row", "columns", "weights"])

    found = sorted((kept[r["row"]], np.frombuffer(r["columns"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in in_small_batches(held.df, bags, "row string, columns binary, weights binary").toLocalIterator()) if len(used) else []
    held.drop()
    found.sort(key=lambda f: f[0])
    if not found:
        return Model(np.zeros((BUCKETS, SIZE), np.float32), np.zeros((SIZE, 2)), np.log(texts / texts.sum()))
    return fit([c for _, c, _ in found], [w for _, _, w in found], np.array([known[i]["toxic"] for i, _, _ in found]), used)


def score_texts(texts: list[bytes], weights: np.ndarray, offset: float) -> np.ndarray:
    """Probability of the toxic class; texts are lower-case."""
    logit = np.full(len(texts), offset)
    for a, b in blocks(texts):
        data, starts, ends, place, first = distinct_words(texts[a:b])
        total, n = np.zeros(len(starts)), np.zeros(len(starts))
        for bucket, word in grams(data, starts, ends):
            if len(word):
                low, high = word[0], word[-1] + 1
                total[low:high] += np.bincount(word - low, weights[bucket], high - low)
                n[low:high] += np.bincount(word - low, minlength=high - low)
        per_word = total / np.maximum(n, 1)
        words = np.diff(first)
        logit[a:b] += np.bincount(np.repeat(np.arange(b - a), words), per_word[place], b - a) / np.maximum(words, 1)
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted for every row of docs.

    Null texts count as empty and get the score of the bias alone. Labels that are null or
    neither 0 nor 1 are not used, nor those of a doc_id that has both; without both classes all
    scores are 0. Null doc_ids are not held out. Repeated rows are scored alike; of rows that
    share a doc_id one trains. Other columns are ignored, an empty table gives an empty result.
    """
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_small_batches(docs.select("doc_id", held_out, "text"), _scorer(docs, labels, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below THRESHOLD, all columns; rows are judged as score() does, one by one."""
    return in_small_batches(docs, _scorer(docs, labels, docs.columns, below=THRESHOLD), docs.schema)


def _scorer(docs: DataFrame, labels: DataFrame, carried: list[str], below: float | None = None):
    model = train(docs, labels)
    weights = docs.sparkSession.sparkContext.broadcast(model.per_bucket() if model else None)
    offset = model.offset() if model else 0.0

    def run(batches):
        for batch in batches:
            found = np.zeros(len(batch)) if weights.value is None else score_texts(lowered(batch.column("text")), weights.value, offset)
            if below is None:
                yield pa.record_batch([*(batch.column(c) for c in carried), pa.array(found)], names=[*carried, "score"])
            else:
                yield batch.filter(pa.array(found < below))

    return run
