"""Personal data: generators propose overlapping spans, boosted trees choose among them.

Base rules find plain forms. They take the leftmost match and drop it whole if it fails, so a
card number beside another number, or a phone number before an address, is lost. Generators
therefore propose every run of neighbouring digit groups that may be a number of its kind, and
every address around an @ or its spelt-out form; they are meant to miss nothing. Gradient-boosted
trees score each proposal by its format and its surroundings. They learn from the base rules:
what these find, also rewritten in disguised forms, is personal data; what overlaps no base
match, or only a part of a sound one, is none; what lies in a failed match is left to the model.

All proposals of all texts are learnt from. Equal ones (in features and label) are counted
together by Spark; trees and thresholds need only sums over these counts, which the driver takes
from its own copy while that fits BROADCAST_BYTES, and beyond it from one pass of tasks for each
level of a tree. Sums are of whole numbers, so both give the same model. Each kind has its own
trees, as formats of one say nothing of another's.

Texts are read whole, one after another, and proposals of a text are scored in blocks, so
memory is bounded by the text. All patterns match in linear time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.staging import BROADCAST_BYTES, Staged, in_small_batches

KINDS = ("email", "ip", "card", "phone")
TREES = 60
DEPTH = 4
RATE = 0.2
#: Most values of a feature that splits are tried at.
EDGES = 32
#: Least number of sample rows on each side of a split.
LEAST_ROWS = 8
#: Precision that accepted proposals of a kind must have on the calibration texts, and the most that a threshold lies under certainty.
PRECISION = 0.99
LEAST_SCORE = 0.9
#: Calibration texts are one in so many.
CALIBRATION = 4
#: Proposals scored at a time.
BLOCK = 1 << 13
#: Greater features count as this.
MOST = 4095
#: Different examples that a task counts at a time.
COUNTED = 1 << 16
#: Slopes and curvatures are summed as whole numbers of this part.
SCALE = 1 << 20
#: Steps of the log odds, up to CLIP, by which calibration counts.
STEPS = 100
CLIP = 50
AROUND = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+", re.IGNORECASE)
_MAYBE_SPELT = re.compile(r"[(\[\x20]at[)\]\x20]", re.IGNORECASE)
_GROUP = re.compile(r"[0-9]++")
_CLUSTER = re.compile(r"[0-9]++(?:[\x20().\[\]/-]{1,3}+[0-9]++)*+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    twice = (2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_matches(text: str) -> Iterator[tuple[Span, bool]]:
    """((kind, start, end), whether it holds) of all base matches, those of each kind from left to right."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield (0, start, found.end()), True
            done = found.end()
        at += 1
    for found in _DOTTED.finditer(text):
        groups = list(_GROUP.finditer(text, *found.span()))
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            yield (1, four[0].start(), four[3].end()), all(octet(g[0]) for g in four)
    for found in _SPACED.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        yield (2, *found.span()), 14 <= len(digits) <= 19 and luhn(digits)
    for found in _PLUS.finditer(text):
        yield (3, *found.span()), 10 <= sum(c.isdecimal() for c in found[0]) <= 15


def proposals(text: str) -> Iterator[Span]:
    """Every span that may be of a kind. A run of neighbouring digit groups gives at most 19 for each group, as each group has a digit."""
    at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > 0 and text[start - 1] in _LOCAL and at - start < 64:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield 0, start, found.end()
        at += 1
    if _MAYBE_SPELT.search(text):
        for found in _SPELT.finditer(text):
            yield 0, *found.span()
    for cluster in _CLUSTER.finditer(text):
        if cluster.end() - cluster.start() < 7:
            continue
        ends, window = [], []
        for group in _GROUP.finditer(text, *cluster.span()):
            window.append(group.span())
            total = 0
            for k in range(len(window) - 1, -1, -1):
                start, end = window[k]
                total += end - start
                if total > 19:
                    window = window[k + 1 :]
                    break
                if total < 4:
                    continue
                n, last = len(window) - k, group.end()
                if n == 4 and total <= 12 and all(b - a <= 3 for a, b in window[k:]):
                    yield 1, start, last
                if total >= 13:
                    yield 2, start, last
                if 7 <= total <= 15:
                    ends.append((start, last))
        for start, last in ends:
            if start and text[start - 1] == "(" and ")" in text[start:last]:
                start -= 1
            if start and text[start - 1] == "+":
                start -= 1
            yield 3, start, last


def _side(c: str) -> int:
    """0 edge, 1 space, 2 letter, 3 digit, 4 + or dash, 5 quote or bracket, 6 other."""
    if not c:
        return 0
    if c.isspace():
        return 1
    return 2 if c.isalpha() or c == "_" else 3 if c.isdecimal() else 4 if c in "+-" else 5 if c in "\"'()[]{}<>" else 6


FEATURES = 27


def features(text: str, span: Span) -> list[float]:
    """Format and surroundings of a proposal, in FEATURES numbers up to MOST."""
    kind, start, end = span
    own = text[start:end]
    groups = [len(g) for g in _GROUP.findall(own)]
    digits = "".join(c for c in own if c in "0123456789")
    marks = [own.count(c) for c in " -.()"]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    left, right = before.rstrip(), after.lstrip()
    labels = re.split(r"\.|dot", own.rpartition("@")[2]) if kind == 0 else []
    found = (
        kind, len(own), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        *marks, own[0] == "+", "@" in own, own.isupper(), luhn(digits) if digits else -1, sum(not octet(g) for g in _GROUP.findall(own)) if kind == 1 else -1,
        len(labels), len(labels[-1].strip()) if labels else 0,
        _side(before[-1:]), _side(after[:1]), _side(left[-1:]), _side(right[:1]),
        sum(c.isdecimal() for c in before), sum(c.isdecimal() for c in after), len(set(digits)),
    )
    return [min(v, MOST) for v in found]


def disguised(text: str, span: Span) -> tuple[str, Span]:
    """The text with a span rewritten as people hide it, in one way of a few by its own bytes, and the span's new place."""
    kind, start, end = span
    own = text[start:end]
    way = zlib.crc32(own.encode()) % 3
    digits = "".join(c for c in own if c in "0123456789")
    if kind == 0:
        one, dot = ((" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"))[way]
        name, _, host = own.partition("@")
        new = name + one + host.replace(".", dot)
    elif kind == 1:
        new = own.replace(".", ("[.]", " . ", "(.)")[way])
    elif kind == 2:
        new = ("-", " ", ".")[way].join("".join(g) for g in batched(digits, 4))
    else:
        new = (f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"+{digits[:-10]}-{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"+{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}")[way]
    return text[:start] + new + text[end:], (kind, start, start + len(new))


def examples(text: str) -> Iterator[tuple[int, list[float]]]:
    """(label, features) of a text's proposals; one in two sound base spans also in a disguised form."""
    matches = list(base_matches(text))
    sound, failed = ({s for s, holds in matches if holds == which} for which in (True, False))
    unclear = np.zeros((len(KINDS), len(text)), bool)
    for kind, start, end in failed:
        unclear[kind, start:end] = True
    for span in proposals(text):
        if span not in sound and (span in failed or not unclear[span[0], span[1] : span[2]].any()):
            yield 0, features(text, span)
    for kind, start, end in sound:
        yield 1, features(text, (kind, start, end))
        if zlib.crc32(text[start:end].encode()) % 2:
            first = max(0, start - AROUND)
            yield 1, features(*disguised(text[first : end + AROUND], (kind, start - first, end - first)))


@dataclass
class Forest:
    """Trees of one depth as arrays, each kind with its own: for each inner node its feature and edge, for each leaf its value."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    start: np.ndarray
    thresholds: np.ndarray

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Sums of leaves over the trees from the `first` on."""
        total, kind = np.zeros(len(x)), x[:, 0].astype(np.int64)
        for feature, edge, leaf in zip(self.feature[first:], self.edge[first:], self.leaf[first:], strict=True):
            total += leaf[kind, leaves(x, kind, feature, edge, DEPTH)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return certainty(self.start[x[:, 0].astype(np.int64)] + self.margins(x))


def certainty(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -CLIP, CLIP)))


def leaves(x: np.ndarray, kind: np.ndarray, feature: np.ndarray, edge: np.ndarray, depth: int) -> np.ndarray:
    """The node of a level of its kind's tree that each row comes to, from 0."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, feature[kind, node]] > edge[kind, node])
    return node - (2**depth - 1)


class Part:
    """Examples that are held at a time, with their numbers. Each method gives sums, which add up over parts."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, counts: np.ndarray):
        self.x, self.labels, self.counts = x, labels, counts
        self.kind = x[:, 0].astype(np.int64)
        self.bins, self.margin, self.trees = None, np.zeros(len(x)), 0

    def totals(self) -> np.ndarray:
        """Numbers of rows of both labels by kind."""
        return np.bincount(2 * self.kind + (self.labels > 0), self.counts, 2 * len(KINDS)).reshape(-1, 2).astype(np.int64)

    def values(self) -> np.ndarray:
        """How often each feature has each value from -1 to MOST."""
        return np.stack([np.bincount(column.astype(np.int64) + 1, self.counts, MOST + 2) for column in self.x.T]).astype(np.int64)

    def margins(self, forest: Forest) -> np.ndarray:
        self.margin, self.trees = self.margin + forest.margins(self.x, self.trees), len(forest.leaf)
        return forest.start[self.kind] + self.margin

    def level(self, forest: Forest, edges: list[np.ndarray], feature: np.ndarray, edge: np.ndarray, depth: int) -> np.ndarray:
        """Slopes, curvatures and numbers of rows by kind, node of a tree's level, feature and bin."""
        if self.bins is None:
            self.bins = np.stack([np.searchsorted(cuts, column, "left") for cuts, column in zip(edges, self.x.T, strict=True)], 1)
        p = certainty(self.margins(forest))
        weights = [np.rint(v * SCALE) * self.counts for v in (p - self.labels, p * (1 - p))] + [self.counts]
        at = (self.kind * 2**depth + leaves(self.x, self.kind, feature, edge, depth)) * (EDGES + 1)
        found = [[np.bincount(at + own, w, len(KINDS) * 2**depth * (EDGES + 1)) for w in weights] for own in self.bins.T]
        return np.array(found).reshape(len(edges), 3, len(KINDS), 2**depth, EDGES + 1).transpose(2, 3, 0, 4, 1).astype(np.int64)

    def graded(self, forest: Forest) -> np.ndarray:
        """Numbers of rows of both labels by kind and step of the log odds."""
        step = np.rint(np.clip(self.margins(forest), -CLIP, CLIP) * STEPS).astype(np.int64) + CLIP * STEPS
        steps = 2 * CLIP * STEPS + 1
        at = (self.kind * steps + step) * 2 + (self.labels > 0)
        return np.bincount(at, self.counts, len(KINDS) * steps * 2).reshape(len(KINDS), steps, 2).astype(np.int64)


#: A method of Part by name, with what it needs -> its sums over all examples.
Ask = Callable[..., np.ndarray]


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values (which ascend) that splits are tried at: quantiles, without the greatest."""
    below = np.cumsum(counts)
    places = np.rint(np.linspace(0, 1, EDGES + 1)[1:-1] * (below[-1] - 1))
    cuts = np.unique(values[np.searchsorted(below, places, "right")])
    return cuts[cuts < values[-1]]


def grow(ask: Ask, forest: Forest, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree for each kind that lowers the loss most at each split, by sums of slopes and curvatures per bin; a node without a good split passes all rows left."""
    inner = 2**DEPTH - 1
    feature, edge, leaf = np.zeros((len(KINDS), inner), np.int64), np.full((len(KINDS), inner), np.inf), np.zeros((len(KINDS), inner + 1))
    for depth in range(DEPTH):
        sums = ask("level", forest, edges, feature, edge, depth) / np.array([SCALE, SCALE, 1])
        for kind, k in np.ndindex(sums.shape[:2]):
            at = kind, 2**depth - 1 + k
            own = sums[kind, k]
            g, h, n = whole = own[0].sum(0)
            left = np.cumsum(own, 1)[:, :-1]
            left_g, left_h, left_n = np.moveaxis(left, 2, 0)
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(left_n < LEAST_ROWS) | (n - left_n < LEAST_ROWS)] = 0
            best = np.unravel_index(gain.argmax(), gain.shape)
            split = whole
            if gain[best] > 1e-3:
                feature[at], edge[at], split = best[0], edges[best[0]][best[1]], left[best]
            if depth == DEPTH - 1:
                leaf[kind, 2 * k : 2 * k + 2] = [-s[0] / (s[1] + 1) for s in (split, whole - split)]
    return feature, edge, leaf


def boosted(learnt: Ask, held: Ask, edges: list[np.ndarray]) -> Forest | None:
    """Boosted on what is learnt from, thresholds on what is held for calibration; None if a class is missing."""
    totals = learnt("totals")
    if not totals.sum(0).all():
        return None
    trees, start = [], np.log((totals[:, 1] + 1) / (totals[:, 0] + 1))
    for _ in range(TREES):
        forest = _forest(trees, start)
        feature, edge, leaf = grow(learnt, forest, edges)
        trees.append((feature, edge, RATE * leaf))
    # A kind without examples is scored as the one with most; without calibration rows its threshold stays over 1.
    used = np.where(totals.any(1), np.arange(len(KINDS)), totals.sum(1).argmax())
    forest = _forest([tuple(v[used] for v in tree) for tree in trees], start[used])
    grades = certainty((np.arange(2 * CLIP * STEPS + 1) - CLIP * STEPS) / STEPS)
    forest.thresholds = np.array([threshold(grades[some], own[some, 1], own[some].sum(1)) for own in held("graded", forest) for some in [own.sum(1) > 0]])
    return forest


def _forest(trees: list[tuple], start: np.ndarray) -> Forest:
    feature, edge, leaf = map(np.array, zip(*trees, strict=True)) if trees else [()] * 3
    return Forest(feature, edge, leaf, start, np.full(len(KINDS), 2.0))


def fit(x: np.ndarray, labels: np.ndarray, calibration: np.ndarray) -> Forest | None:
    """Boosted on the rows that aren't for calibration, thresholds on those that are; None if a class is missing."""
    parts = [Part(x[some], labels[some].astype(float), np.ones(some.sum())) for some in (~calibration, calibration)]
    learnt, held = (lambda name, *state, part=part: getattr(part, name)(*state) for part in parts)
    return boosted(learnt, held, [cuts_of(*np.unique(column, return_counts=True)) for column in parts[0].x.T])


def threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Half way between the least score down to which PRECISION holds throughout and the next one, LEAST_SCORE at least; over 1 if there is none.

    With counts, a score stands for so many rows, of which labels says how many are of the class.
    """
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    precision = np.cumsum(labels[order]) / np.cumsum(np.ones(len(order)) if counts is None else counts[order])
    last = np.diff(ranked, append=-1.0) != 0
    failing = ranked[last & (precision < PRECISION)].max(initial=0.0)
    sure = ranked[ranked > failing]
    return max(LEAST_SCORE, (sure.min() + failing) / 2) if len(sure) else 2.0


def counted_examples(docs: DataFrame) -> Staged:
    """x (features as two bytes each), label, held (for calibration, by the text), n: all different examples of all texts of docs(text), with their numbers."""

    def run(batches):
        found = Counter()

        def rows():
            keys = list(found)
            columns = [pa.array([k[2] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[0] for k in keys], pa.bool_()), pa.array(list(found.values()), pa.int64())]
            found.clear()
            return pa.record_batch(columns, names=["x", "label", "held", "n"])

        for batch in batches:
            for held, text in zip(batch.column("held").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for label, x in examples(text):
                    found[held, label, np.array(x, np.int16).tobytes()] += 1
                    if len(found) >= COUNTED:
                        yield rows()
        if found:
            yield rows()

    texts = docs.filter("text is not null").select("text", (F.xxhash64("text") % CALIBRATION == 0).alias("held"))
    return Staged(in_small_batches(texts, run, "x binary, label int, held boolean, n long").groupBy("x", "label", "held").agg(F.sum("n").alias("n")))


def part_of(rows: pa.Table | pa.RecordBatch) -> Part:
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.int16).reshape(-1, FEATURES).astype(float)
    return Part(x, *(rows.column(c).to_numpy().astype(float) for c in ("label", "n")))


def of_tasks(rows: DataFrame) -> Ask:
    """Sums over rows(x, label, n) that stay where they are: one pass over them for each."""

    def ask(name: str, *state) -> np.ndarray:
        def run(batches):
            found = None
            for batch in batches:
                own = getattr(part_of(batch), name)(*state)
                found = own if found is None else found + own
            if found is not None:
                yield pa.record_batch([pa.array([found.tobytes()], pa.binary())], names=["sums"])

        none = getattr(Part(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0)), name)(*state)
        return sum((np.frombuffer(r["sums"], np.int64).reshape(none.shape) for r in in_small_batches(rows, run, "sums binary").toLocalIterator()), none)

    return ask


def train(docs: DataFrame) -> Forest | None:
    counted = counted_examples(docs)
    few = counted.rows() * (2 * FEATURES + 32) <= BROADCAST_BYTES

    def ask(held: bool) -> Ask:
        rows = counted.df.filter(F.col("held") == held).select("x", "label", "n")
        if not few:
            return of_tasks(rows)
        part = part_of(rows.toArrow())
        return lambda name, *state: getattr(part, name)(*state)

    learnt, held = ask(False), ask(True)
    values = learnt("values")
    forest = boosted(learnt, held, [cuts_of(np.flatnonzero(own) - 1.0, own[own > 0]) for own in values]) if values.any() else None
    counted.drop()
    return forest


def added(text: str, base: list[Span], forest: Forest) -> list[Span]:
    """Proposals over their kind's threshold that overlap neither a base span nor one of a higher score; of equal scores the longer, then the earlier."""
    taken = bytearray(len(text))
    for _, start, end in base:
        taken[start:end] = b"\1" * (end - start)
    accepted = []
    for some in batched((s for s in proposals(text) if not any(taken[s[1] : s[2]])), BLOCK):
        x = np.array([features(text, s) for s in some], float)
        scores = forest.scores(x)
        over = np.flatnonzero(scores >= forest.thresholds[x[:, 0].astype(int)])
        accepted += [(-scores[i], some[i][1] - some[i][2], some[i][1], some[i]) for i in over.tolist()]
    found = []
    for *_, (kind, start, end) in sorted(accepted):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append((kind, start, end))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans of the base rules), spans (these and the model's) of every row of docs(doc_id, text).

    Spans are kind:start:end in code points, by start, then kind. Null texts are empty. Without
    base spans, or without anything else, to learn from, only base spans are returned. Repeated
    rows are treated alike. Other columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                base = [s for s, holds in base_matches(text or "") if holds]
                more = added(text, base, model.value) if text and model.value else []
                found.append((*(sum(s[0] == k for s in base) for k in range(len(KINDS))), listed(base), listed(base + more)))
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return in_small_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; overlapping spans count as one of the first's kind."""
    out, done = [], 0
    for span in spans.split(",") if spans else []:
        kind, start, end = span.split(":")
        if int(start) >= done:
            out += [text[done : int(start)], f"[{kind.upper()}]"]
        done = max(done, int(end))
    return "".join([*out, text[done:]])
