"""Substring dedup by level-wise doubling.

Windows repeated at one length alone are extended to the next: short anchors first, then
windows of LENGTH words where an anchor repeats, then 2, 4, 8 ... times LENGTH where both halves
repeat, until no candidates survive. At every level a window counts as repeated if its words
also start in another document.

Documents are written once as segments: runs of consecutive doc_ids, packed and compressed, so
that the order of segments is the order of doc_ids. A level then moves hashes only. Each
segment sends the set of its candidates' hashes, split by hash range; a range's task finds the
values that several segments hold and answers each of them, saying whether an earlier segment
has the value; the segment combines that with what its own documents share. A passage that a
third of all documents share reaches its range's task once per segment.

Anchors are windows of ANCHOR words, and of the windows of LENGTH words only those can repeat
whose least anchor (by hash) repeats: equal windows have equal least anchors. Neighbouring
windows mostly share that, so the first level moves about a fifth of the hashes it stands for.

Windows are compared by 64-bit hashes: among 10^9 windows the chance that any two differ yet
agree is about 3 %.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import Staged, in_small_batches
from lodestone.llm.wordbytes import blocks, boundaries, combine, pack, pack_plain, split_ranges, texts_of, unpack, unpack_plain, windows, word_hashes

LENGTH = 13
ANCHOR = 7
#: Bytes of text in a segment.
SEGMENT_BYTES = 4 << 20
#: Segments a hash range; a range's task holds what they all send it, so their number grows with the corpus.
RANGE_SEGMENTS = 2
#: doc_id that stands for null: after all others.
LAST = np.iinfo(np.int64).max
_CHUNKS = 1 << 24

_PACKED = "seg long, kind string, ids binary, sizes binary, body binary"
_PIECES = "seg long, kind string, range int, ids binary, sizes binary, body binary"


def segments(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as segments in doc_id order; equal doc_ids share one."""

    def run(batches):
        first = TaskContext.get().partitionId() * _CHUNKS
        ids, texts, held, made = [], [], 0, 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                i = LAST if i is None else i
                if held >= SEGMENT_BYTES and i != ids[-1]:
                    yield _segment(first + made, ids, texts)
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield _segment(first + made, ids, texts)

    order = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_small_batches(rows.repartitionByRange(order).sortWithinPartitions(order), run, _PACKED)


def _record(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), kind) for c, (_, kind) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_B = pa.binary()
_SEG = [("seg", pa.int64()), ("kind", pa.string()), ("ids", _B), ("sizes", _B), ("body", _B)]
_PIECE = [("seg", pa.int64()), ("kind", pa.string()), ("range", pa.int32()), ("ids", _B), ("sizes", _B), ("body", _B)]


def _segment(seg: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], np.int64)
    return _record(_SEG, [(seg, "text", pack_plain(np.array(ids, np.int64)), pack_plain(sizes), zstandard.compress(b"".join(texts), 3))])


class _Block:
    """Some consecutive documents of a segment: their words, and where windows of LENGTH words lie within one document."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.data, self.starts, self.ends, self.first = boundaries(texts)
        self.words = word_hashes(self.data, self.starts, self.ends)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.n = max(0, len(self.words) - LENGTH + 1)
        self.at = np.flatnonzero(np.arange(self.n) + LENGTH <= self.first[owner[: self.n] + 1])
        self.row = owner[self.at]
        self.doc = ids[self.row]

    @cached_property
    def hash(self) -> np.ndarray:
        return windows(self.words, LENGTH)[self.at]

    @cached_property
    def anchor(self) -> np.ndarray:
        """Least hash of the ANCHOR-word windows in each window."""
        short = windows(self.words, ANCHOR)
        least = short[: self.n].copy()
        for k in range(1, LENGTH - ANCHOR + 1):
            np.minimum(least, short[k : k + self.n], out=least)
        return least[self.at]


def _read_segment(row: dict) -> Iterator[tuple[int, list[bytes], _Block]]:
    """(place of the first document in the segment, texts, block)."""
    ids, sizes = unpack_plain(row["ids"], np.int64), unpack_plain(row["sizes"], np.int64)
    body = zstandard.decompress(row["body"])
    ends = np.cumsum(sizes)
    texts = [body[b - s : b] for b, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    for a, b in blocks(texts):
        yield a, texts[a:b], _Block(ids[a:b], texts[a:b])


def _pieces(seg: int, values: np.ndarray, ranges: int) -> pa.RecordBatch:
    """The set of a segment's hashes, a row for each hash range."""
    return _record(_PIECE, [(seg, "set", k, None, None, pack(values[a:b])) for k, a, b in split_ranges(values, ranges)])


def _answers(sets: DataFrame, ranges: int) -> DataFrame:
    """For each segment the values it shares with others, and of each whether an earlier segment has it."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["seg", "body"]).to_pylist(), key=lambda r: r["seg"])
        parts = [unpack(r["body"]) for r in rows]
        values = np.concatenate(parts)
        place = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(values, kind="stable")
        v, place = values[order], place[order]
        same = v[1:] == v[:-1]
        before = np.concatenate([[False], same])
        shared = before | np.concatenate([same, [False]])
        v, place, before = v[shared], place[shared], before[shared]
        out = []
        for k in np.unique(place):
            mine = place == k
            out.append((rows[k]["seg"], "answer", table["range"][0].as_py(), None, pack_plain(np.packbits(before[mine])), pack(v[mine])))
        return pa.Table.from_batches([_record(_PIECE, out)])

    return sets.groupBy("range").applyInArrow(run, _PIECES)


def _known(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """All answers to a segment: sorted values, and whether an earlier segment has each."""
    parts = [(unpack(r["body"]), r["sizes"]) for r in sorted(rows, key=lambda r: r["range"])]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate([v for v, _ in parts]), np.concatenate([np.unpackbits(unpack_plain(s, np.uint8))[: len(v)].astype(bool) for v, s in parts])


def _judge(values: np.ndarray, docs: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: whether another document starts with them too, and whether one of a smaller doc_id does.

    docs are the windows' own doc_ids, known what other segments have.
    """
    shared, earlier = np.zeros(len(values), bool), np.zeros(len(values), bool)
    if not len(values):
        return shared, earlier
    order = np.argsort(values)
    v, d = values[order], docs[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
    several, before = low != high, np.zeros(len(first), bool)
    others, smaller = known
    if len(others):
        distinct = v[first]
        place = np.minimum(np.searchsorted(distinct, others), len(distinct) - 1)
        hit = distinct[place] == others
        several[place[hit]] = True
        before[place[hit & smaller]] = True
    group = np.cumsum(new) - 1
    shared[order] = several[group]
    earlier[order] = before[group] | (low[group] < d)
    return shared, earlier


def _split(table: pa.Table) -> tuple[list[dict], list[dict]]:
    rows = table.to_pylist()
    return [r for r in rows if r["kind"] not in ("answer", "set")], [r for r in rows if r["kind"] == "answer"]


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:n]) > 0


_RESULT = "seg long, kind string, range int, ids binary, sizes binary, body binary, doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>, length long"
_NO_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("length", pa.int64())]


def _widened(batch: pa.RecordBatch) -> pa.Table:
    table = pa.Table.from_batches([batch])
    for name, kind in _NO_RESULT:
        table = table.append_column(name, pa.nulls(len(table), kind))
    return table


def _doubled(seg: int, row: np.ndarray, at: np.ndarray, value: np.ndarray, ids: np.ndarray, docs: np.ndarray, length: int, ranges: int) -> list[pa.Table]:
    """From the shared windows of one length: the candidates of twice the length, as state and as a set.

    A candidate starts where a shared window does, and another one starts `length` words on.
    """
    place = row.astype(np.int64) << 32 | at
    order = np.argsort(place)
    row, at, value, place = row[order], at[order], value[order], place[order]
    next_ = np.searchsorted(place, place + length)
    both = next_ < len(place)
    both[both] = place[next_[both]] == place[both] + length
    row, at, joined = row[both], at[both], combine(value[both], value[next_[both]])
    if not len(row):
        return []
    state = (seg, "state", None, pack_plain(ids), pack_plain(np.concatenate([row, at]).astype(np.uint32)), pack_plain(joined))
    return [_widened(_record(_PIECE, [state])), _widened(_pieces(seg, np.unique(joined), ranges))]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed words, end excluded) and longest of every row of docs.

    A word goes if a window of LENGTH words that covers it also starts in a document of smaller
    doc_id, all judged on the input. `longest` is the greatest length LENGTH * 2^k of which a
    window of the document also starts in one of smaller doc_id; null if none does. Null texts
    have no words; null doc_ids come after all others, and rows of equal doc_id are not repeats
    of each other. Texts shorter than a window lose nothing. Other columns are ignored, an empty
    table gives an empty result.
    """
    held = Staged(segments(docs))
    ranges = max(1, -(-held.rows() // RANGE_SEGMENTS))

    def anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [np.unique(block.anchor) for _, _, block in _read_segment(row)]
                yield _pieces(row["seg"], np.unique(np.concatenate(found)), ranges)

    def candidates(table: pa.Table) -> pa.Table:
        own_rows, answers = _split(table)
        if not own_rows:
            return pa.Table.from_batches([_record(_PIECE, [])])
        known = _known(answers)
        read = list(_read_segment(own_rows[0]))
        anchor, doc = (np.concatenate([getattr(b, c) for _, _, b in read]) for c in ("anchor", "doc"))
        shared, _ = _judge(anchor, doc, known)
        hashes = np.concatenate([b.hash for _, _, b in read])
        return pa.Table.from_batches([_pieces(own_rows[0]["seg"], np.unique(hashes[shared]), ranges)])

    def removed(table: pa.Table) -> pa.Table:
        own_rows, answers = _split(table)
        if not own_rows:
            return _widened(_record(_PIECE, []))
        seg, known = own_rows[0]["seg"], _known(answers)
        read = list(_read_segment(own_rows[0]))
        hashes, docs_ = (np.concatenate([getattr(b, c) for _, _, b in read]) for c in ("hash", "doc"))
        shared, earlier = _judge(hashes, docs_, known)
        out, rows, ats, seen = [], [], [], 0
        ids = unpack_plain(own_rows[0]["ids"], np.int64)
        for first, texts, block in read:
            here = slice(seen, seen + len(block.hash))
            seen += len(block.hash)
            covered = _covered(block.at[earlier[here]], LENGTH, len(block.starts))
            rows.append(block.row + first)
            ats.append(block.at - block.first[block.row])
            hit = np.zeros(len(texts), bool)
            hit[block.row[earlier[here]]] = True
            out.extend(_cut(texts[i], i, block, covered, None if ids[first + i] == LAST else int(ids[first + i]), LENGTH if hit[i] else None) for i in range(len(texts)))
        results = pa.table({"seg": pa.array([seg] * len(out), pa.int64()), "kind": pa.array(["result"] * len(out)), "range": pa.nulls(len(out), pa.int32()), "ids": pa.nulls(len(out), _B), "sizes": pa.nulls(len(out), _B), "body": pa.nulls(len(out), _B)} | {name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(_NO_RESULT)})
        row, at = np.concatenate(rows)[shared], np.concatenate(ats)[shared]
        return pa.concat_tables([results, *_doubled(seg, row, at, hashes[shared], ids, docs_, LENGTH, ranges)])

    def at_length(length: int):
        def level(table: pa.Table) -> pa.Table:
            own_rows, answers = _split(table)
            if not own_rows:
                return _widened(_record(_PIECE, []))
            state, known = own_rows[0], _known(answers)
            ids, value = unpack_plain(state["ids"], np.int64), unpack_plain(state["body"], np.uint64)
            row, at = unpack_plain(state["sizes"], np.uint32).astype(np.int64).reshape(2, -1)
            doc = ids[row]
            shared, earlier = _judge(value, doc, known)
            long_ = np.unique(doc[earlier])
            n = len(long_)
            found = pa.table({"seg": pa.array([state["seg"]] * n, pa.int64()), "kind": pa.array(["length"] * n, pa.string()), "range": pa.nulls(n, pa.int32()), "ids": pa.nulls(n, _B), "sizes": pa.nulls(n, _B), "body": pa.nulls(n, _B), "doc_id": pa.array([None if d == LAST else d for d in long_.tolist()], pa.int64()), "n_words": pa.nulls(n, pa.int64()), "n_removed": pa.nulls(n, pa.int64()), "kept_sha256": pa.nulls(n, pa.string()), "spans": pa.nulls(n, _NO_RESULT[4][1]), "length": pa.array([length] * n, pa.int64())})
            return pa.concat_tables([found, *_doubled(state["seg"], row[shared], at[shared], value[shared], ids, doc, length, ranges)])

        return level

    def with_answers(own: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
        columns = ["seg", "kind", "range", "ids", "sizes", "body"]
        own = own if "range" in own.columns else own.withColumn("range", F.lit(None).cast("int"))
        return own.select(columns).unionByName(answers.select(columns)).groupBy("seg").applyInArrow(run, schema)

    answered = Staged(_answers(held.df.mapInArrow(anchors, _PIECES), ranges))
    sets = with_answers(held.df, answered.df, candidates, _PIECES)
    after = Staged(_answers(sets, ranges))
    answered.drop()
    first = Staged(with_answers(held.df, after.df, removed, _RESULT), partition_by="kind")
    held.drop()
    after.drop()
    current, lengths, length = first, first.df.filter("kind = 'result' and length is not null").select("doc_id", "length"), LENGTH
    while not current.df.filter("kind = 'state'").isEmpty():
        length *= 2
        after = Staged(_answers(current.df.filter("kind = 'set'"), ranges))
        following = Staged(with_answers(current.df.filter("kind = 'state'"), after.df, at_length(length), _RESULT), partition_by="kind")
        after.drop()
        lengths = lengths.unionByName(following.df.filter("kind = 'length'").select("doc_id", "length"))
        current = following
    longest = lengths.groupBy(F.col("doc_id").alias("of")).agg(F.max("length").alias("longest"))
    results = first.df.filter("kind = 'result'").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")
    return results.join(longest, results["doc_id"].eqNullSafe(longest["of"]), "left").drop("of")


def _cut(text: bytes, i: int, block: _Block, covered: np.ndarray, doc_id: int | None, length: int | None) -> tuple:
    """A document's result: what is left of it once the covered words are gone."""
    a, b = int(block.first[i]), int(block.first[i + 1])
    gone = covered[a:b]
    words = text.split()
    if not gone.any():
        return doc_id, b - a, 0, hashlib.sha256(b" ".join(words)).hexdigest(), [], length
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = [{"first": int(x), "end": int(y)} for x, y in zip(edges[0::2], edges[1::2], strict=True)]
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return doc_id, b - a, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), spans, length
