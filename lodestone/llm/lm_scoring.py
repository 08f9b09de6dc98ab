"""LM scoring by cross-entropy difference.

Two interpolated word-bigram models, of the target documents and of all others, share one
vocabulary, one set of bigrams and one smoothing, and are matched in size: the counts of the
larger side are scaled down to the words of the smaller, which is what a sample of that size
holds on average. The mean over a document's words of target loss minus background loss is its
score: below 0 reads like the target. A document is judged without its own words, which are
taken out of the model of its side.

Both models hold every word and bigram that occurs LEAST_COUNT times in the corpus, so they grow
with it. Rarer words are one class, whose probability both models hold; rarer bigrams fall back
to their second word, and their counts are taken out of their first word's context, so that a
bigram left out favours neither model.

No task and no broadcast holds a model. Documents become units of some UNIT_WORDS words, kept as
places in the unit's sorted distinct words. A unit sends its distinct bigrams, then its words, in
packed hash ranges, one row each; the range adds up all units' counts and answers each unit with
the corpus' counts of what it sent, in the same order. A very frequent word or pair is one entry
a unit. The units then meet their answers and score their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged, in_small_batches
from lodestone.llm.wordbytes import blocks, boundaries, combine, pack, pack_plain, split_ranges, texts_of, unpack, unpack_plain, word_hashes

LEAST_COUNT = 2
#: Weight, in words, of the unigram model behind every context.
PRIOR = 50.0
#: Words of which losses are worked out at a time, unless one document has more.
STEP_WORDS = 1 << 17
#: Words at which a unit of documents is closed.
UNIT_WORDS = 1 << 20
#: Words of the corpus a hash range; a range is added up in one piece, so their number grows with the corpus.
RANGE_WORDS = 1 << 20

_UNIT = {"unit": pa.int64(), "ids": pa.binary(), "lengths": pa.binary(), "hits": pa.binary(), "words": pa.binary(), "at": pa.binary(), "n": pa.int64(), "n_target": pa.int64()}
_SENT = {"range": pa.int32(), "unit": pa.int64(), "keys": pa.binary(), "target": pa.binary(), "background": pa.binary(), "firsts": pa.binary()}
_ANSWER = {"kind": pa.string(), "range": pa.int32(), "unit": pa.int64(), "keys": pa.binary(), "target": pa.binary(), "background": pa.binary(), "context_target": pa.binary(), "context_background": pa.binary()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _ddl(columns: dict) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in columns.items())


def _rows(rows: list[dict], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(columns.items())))


def _squeezed(values: np.ndarray) -> bytes:
    """64-bit counts, byte plane by byte plane."""
    return pack_plain(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T))


def _spread(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack_plain(blob, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


@dataclass
class Unit:
    """Documents as places in the sorted distinct words; `hits` says which are of the target."""

    lengths: np.ndarray
    hits: np.ndarray
    words: np.ndarray
    at: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Unit:
        return cls(unpack_plain(row["lengths"], np.int64), unpack_plain(row["hits"], np.bool_), unpack(row["words"]), unpack_plain(row["at"], np.int32))

    def follows(self) -> np.ndarray:
        """Places of the words that have a word before them in their text."""
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        inner = np.ones(len(self.at), bool)
        inner[first] = False
        return np.flatnonzero(inner)

    def pairs(self, places: np.ndarray) -> np.ndarray:
        """The bigrams that end at these places."""
        return combine(self.words[self.at[places - 1]], self.words[self.at[places]])

    def in_target(self) -> np.ndarray:
        return np.repeat(self.hits, self.lengths)


def units(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, target) as units; every row is in one."""
    enough = UNIT_WORDS

    def build(batches):
        ids, lengths, hits, found = [], [], [], []
        made = 0

        def close() -> pa.RecordBatch:
            nonlocal made
            sink = pa.BufferOutputStream()
            column = pa.record_batch([pa.concat_arrays(ids)], names=["doc_id"])
            with pa.ipc.new_stream(sink, column.schema) as out:
                out.write_batch(column)
            n, hit = np.concatenate(lengths), np.concatenate(hits)
            words, at = np.unique(np.concatenate(found), return_inverse=True)
            row = {"unit": (TaskContext.get().partitionId() << 32) + made, "ids": sink.getvalue().to_pybytes(), "lengths": pack_plain(n), "hits": pack_plain(hit), "words": pack(words), "at": pack_plain(at.astype(np.int32)), "n": int(n.sum()), "n_target": int(n[hit].sum())}
            made += 1
            for part in (ids, lengths, hits, found):
                part.clear()
            return _rows([row], _UNIT)

        for batch in batches:
            texts = texts_of(batch.column("text"))
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in blocks(texts):
                data, starts, ends, first = boundaries(texts[a:b])
                ids.append(batch.column("doc_id").slice(a, b - a))
                lengths.append(np.diff(first).astype(np.int64))
                hits.append(target[a:b])
                found.append(word_hashes(data, starts, ends))
                if sum(map(len, found)) >= enough:
                    yield close()
        if ids:
            yield close()

    return in_small_batches(rows, build, _ddl(_UNIT))


def _each(batches) -> Iterator[tuple[int, Unit]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["unit"], Unit.read(row)


def pairs_sent(found: DataFrame, ranges: int) -> DataFrame:
    """Each unit's distinct bigrams with their counts, and the first words of those that may be cut."""

    def send(batches):
        for name, unit in _each(batches):
            places = unit.follows()
            keys, one, where, n = np.unique(unit.pairs(places), return_index=True, return_inverse=True, return_counts=True)
            target = np.bincount(where, unit.in_target()[places], len(keys))
            rare = n < LEAST_COUNT
            firsts = unit.words[unit.at[places[one] - 1]]
            cuts = split_ranges(keys, ranges)
            yield _rows([{"range": k, "unit": name, "keys": pack(keys[a:b]), "target": _squeezed(target[a:b]), "background": _squeezed(n[a:b]), "firsts": pack_plain(firsts[a:b][rare[a:b]])} for k, a, b in cuts], _SENT)

    return found.mapInArrow(send, _ddl(_SENT))


def words_sent(found: DataFrame, ranges: int) -> DataFrame:
    """Each unit's distinct words with their counts."""

    def send(batches):
        for name, unit in _each(batches):
            n = np.bincount(unit.at, minlength=len(unit.words))
            target = np.bincount(unit.at, unit.in_target(), len(unit.words))
            yield _rows([{"range": k, "unit": name, "keys": pack(unit.words[a:b]), "target": _squeezed(target[a:b]), "background": _squeezed(n[a:b]), "firsts": None} for k, a, b in split_ranges(unit.words, ranges)], _SENT)

    return found.mapInArrow(send, _ddl(_SENT))


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys, each entry's place in them, the entries' own counts, and the distinct keys' sums."""
    keys, where = np.unique(_joined([unpack(r["keys"]) for r in rows], np.uint64), return_inverse=True)
    own = [_joined([_spread(r[c]) for r in rows], np.int64) for c in ("target", "background")]
    sums = [np.bincount(where, v, len(keys)).astype(np.int64) for v in own]
    return keys, where, own, *sums


def pairs_judged(sent: DataFrame, ranges: int) -> DataFrame:
    """Answers with the bigrams' counts (0 for those cut), and by first word the counts that were cut."""

    def judge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, where, own, target, background = _added(rows)
        cut = background < LEAST_COUNT
        lost = cut[where]
        firsts = _joined([unpack_plain(r["firsts"], np.uint64) for r in rows], np.uint64)[lost[own[1] < LEAST_COUNT]]
        words, of = np.unique(firsts, return_inverse=True)
        gone = [np.bincount(of, v[lost], len(words)) for v in own]
        out = [{"kind": "cut", "range": k, "unit": -1, "keys": pack(words[a:b]), "target": _squeezed(gone[0][a:b]), "background": _squeezed(gone[1][a:b])} for k, a, b in split_ranges(words, ranges)]
        target[cut] = background[cut] = 0
        begin = 0
        for r in rows:
            mine = where[begin : (begin := begin + len(unpack(r["keys"])))]
            out.append({"kind": "pair", "range": r["range"], "unit": r["unit"], "target": _squeezed(target[mine]), "background": _squeezed(background[mine])})
        return pa.Table.from_batches([_rows(out, _ANSWER)])

    return sent.groupBy("range").applyInArrow(judge, _ddl(_ANSWER))


def words_judged(sent: DataFrame) -> DataFrame:
    """Answers with the words' counts and their contexts' (0 for the class of rare words), and a row of totals a range."""

    def judge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["unit"] < 0)
        asked = [r for r in rows if r["unit"] >= 0]
        keys, where, own, *_ = _added(rows)
        sizes = [len(unpack(r["keys"])) for r in asked]
        n = sum(sizes)
        target, background = (np.bincount(where[:n], v[:n], len(keys)).astype(np.int64) for v in own)
        context = [np.bincount(where[:n], v[:n], len(keys)) - np.bincount(where[n:], v[n:], len(keys)) for v in own]
        rare = background < LEAST_COUNT
        for v in (target, background, *context):
            v[rare] = 0
        out = [{"kind": "total", "range": 0, "unit": -1, "target": _squeezed(np.array([(~rare).sum(), target.sum(), background.sum()]))}]
        begin = 0
        for r, size in zip(asked, sizes, strict=True):
            mine = where[begin : (begin := begin + size)]
            out.append({"kind": "word", "range": r["range"], "unit": r["unit"], "target": _squeezed(target[mine]), "background": _squeezed(background[mine]), "context_target": _squeezed(context[0][mine]), "context_background": _squeezed(context[1][mine])})
        return pa.Table.from_batches([_rows(out, _ANSWER)])

    return sent.groupBy("range").applyInArrow(judge, _ddl(_ANSWER))


def _own(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """At every place, how often its document has its value."""
    _, where, n = np.unique(doc << 32 | value, return_inverse=True, return_counts=True)
    return n[where]


def losses(unit: Unit, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, totals: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(target, background) loss in nats of every word.

    words and contexts hold by distinct word, pairs by distinct bigram, how often the target and
    the rest have it (0 if rare); totals are the sides' words, known the vocabulary's size and its
    words on each side.
    """
    places = unit.follows()
    pair_at = np.full(len(unit.at), -1)
    _, pair_at[places] = np.unique(unit.pairs(places), return_inverse=True)
    kept = np.append(pairs.sum(1) > 0, False)[pair_at]
    rare = words.sum(1) == 0
    scale = totals.min() / np.maximum(totals, 1) if totals.min() else np.ones(2)
    found = np.empty((len(unit.at), 2))
    ends = np.cumsum(unit.lengths)
    firsts = ends - unit.lengths
    steps = np.flatnonzero(np.diff(np.concatenate([[-1], firsts // STEP_WORDS])))
    for a, b in zip(steps, [*steps[1:], len(ends)], strict=True):
        here = slice(int(firsts[a]), int(ends[b - 1]))
        at, pair, held = unit.at[here].astype(np.int64), pair_at[here], kept[here]
        doc = np.repeat(np.arange(b - a), unit.lengths[a:b])
        n, side = unit.lengths[a:b][doc], np.where(unit.hits[a:b], 0, 1)[doc]
        before = np.concatenate([[0], at[:-1]])
        own_word, own_pair, own_context = _own(doc, np.where(rare[at], len(rare), at)), np.zeros(len(at)), np.zeros(len(at))
        own_pair[held] = _own(doc[held], pair[held])
        own_first, index = np.unique(doc[held] << 32 | before[held], return_counts=True)
        asked = doc << 32 | before
        spot = np.minimum(np.searchsorted(own_first, asked), max(0, len(own_first) - 1))
        if len(own_first):
            own_context = np.where(own_first[spot] == asked, index[spot], 0)
        last = unit.at[ends[a:b] - 1].astype(np.int64)[doc]
        own_context = own_context + ((before == last) & ~rare[before])
        follows = pair >= 0
        for k in (0, 1):
            mine = side == k
            size = (totals[k] - mine * n) * scale[k]
            one = (np.where(rare[at], totals[k] - known[1 + k], words[at, k]) - mine * own_word) * scale[k]
            unigram = (one + 1.0) / (size + known[0] + 1.0)
            seen = np.where(held, np.append(pairs[:, k], 0)[pair] - mine * own_pair, 0) * scale[k]
            context = np.where(follows, contexts[before, k] - mine * own_context, 0) * scale[k]
            found[here, k] = -np.log((seen + PRIOR * unigram) / (context + PRIOR))
    return found


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means a word) and score, their difference, of every row of docs.

    Losses are of models without the row's own words. targets(doc_id) names the documents of the target; ids without a document and null ids
    change nothing, repeats count once. Null texts and texts without words have null losses.
    The model of a side without words is uniform; the other is then not scaled. Repeated rows count and are scored each.
    Other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    chosen = Staged(targets.filter("doc_id is not null").select(F.col("doc_id").alias("of")).distinct().withColumn("hit", F.lit(True)))
    rows = docs.select("doc_id", "text").join(chosen.for_join(16), F.col("doc_id") == F.col("of"), "left")
    held = Staged(units(rows.select("doc_id", "text", F.coalesce("hit", F.lit(False)).alias("target"))))
    totals_of = held.df.agg(F.sum("n_target"), F.sum("n")).first()
    chosen.drop()
    target, every = (v or 0 for v in totals_of)
    totals = np.array([target, every - target], np.int64)
    ranges = max(1, -(-every // RANGE_WORDS))

    pairs = Staged(pairs_judged(pairs_sent(held.df, ranges), ranges), "kind")
    cut = pairs.df.filter("kind = 'cut'").select("range", "unit", "keys", "target", "background", F.lit(None).cast("binary").alias("firsts"))
    words = Staged(words_judged(words_sent(held.df, ranges).unionByName(cut)), "kind")
    parts = [_spread(r["target"]) for r in words.df.filter("kind = 'total'").select("target").collect()]
    known = np.sum([np.zeros(3, np.int64), *parts], axis=0)
    known[2] -= known[1]

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ("target", "background", "context_target", "context_background")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["range"])
        own = next(r for r in rows if r["kind"] == "unit")
        unit = Unit.read(own)
        of = lambda kind, c: _joined([_spread(r[c]) for r in rows if r["kind"] == kind], np.int64)
        word, pair = (np.stack([of(k, c) for c in fields[:2]], 1) for k in ("word", "pair"))
        context = np.stack([of("word", c) for c in fields[2:]], 1)
        for counts in (word, pair, context):
            counts[:, 1] -= counts[:, 0]
        found = losses(unit, word, context, pair, totals, known)
        n = unit.lengths
        text = np.repeat(np.arange(len(n)), n)
        means = np.stack([np.bincount(text, found[:, k], len(n)) for k in (0, 1)], 1) / np.maximum(n, 1)[:, None]
        values = [pa.array(v, mask=n == 0) for v in (means[:, 0], means[:, 1], means[:, 0] - means[:, 1])]
        ids = pa.ipc.open_stream(own["ids"]).read_all().column("doc_id")
        return pa.table([ids, pa.array(n), *values], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    answers = pairs.df.filter("kind = 'pair'").unionByName(words.df.filter("kind = 'word'")).select("kind", "range", "unit", *fields)
    own = held.df.select(F.lit("unit").alias("kind"), F.lit(-1).alias("range"), "unit", "ids", "lengths", "hits", "words", "at")
    both = own.unionByName(answers, allowMissingColumns=True)
    return both.groupBy("unit").applyInArrow(run, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")
