"""Resampling, fill-in-middle and personal data against plain counterparts, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, personal_data, queries, resampling
from lodestone.session import table
from tests.conftest import SF, multiset
from tests.llm.test_llm import DOC, WORST

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


@pytest.fixture(scope="module")
def worst(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    texts = [*WORST, "a<P>b c", "😀 <S", "mail a.b@c.de or +1 (234) 555-6789 10.0.0.1", "1 " * 3000, "4111 1111 1111 1111", "w " * 25, "w " * 25]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[-1], rows[-1], (None, "one", None, None, 1), (None, None, None, None, None), (None, "w " * 25, None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    for name in ("key", "words", "n_features", "buckets", "weight", "score", "rank", "part", "place", "may", "below", "id", "n", "form", "output", "hash", "base", "spans"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def drawn_plainly(docs, targets, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) by the definition, one text after another."""
    def buckets(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [zlib.crc32(w.encode()) % 10000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]

    own = [(i, buckets(t)) for i, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in targets for b in buckets(x))
    total, aim = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in range(10000)]
    rows = []
    for i, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r, place.get(id(r))) for r in rows)


def resampled(rows):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows.collect())


def test_op11_agrees_with_plain_counting(spark):
    docs, targets = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = drawn_plainly([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in targets.collect()])
    assert resampled(queries.op11_resampling(spark, SF)) == want
    assert sum(k[4] is not None for k in want) > 50


@pytest.mark.parametrize(("bits", "rows"), [(12, 1 << 16), (2, 1)])
def test_worst_rows_are_drawn_by_the_definition(spark, worst, monkeypatch, bits, rows):
    monkeypatch.setattr(resampling, "DIGIT_BITS", bits)
    monkeypatch.setattr(resampling, "RANGE_ROWS", rows)
    plain = [(r.doc_id, r.text) for r in worst.collect()]
    targets = spark.createDataFrame([("one two",), (None,), ("W w w",)], "text string")
    for percent in (0, 30, 60, 100):
        assert resampled(resampling.resample(worst, targets, percent=percent)) == drawn_plainly(plain, ["one two", "W w w"], percent)
    assert resampling.resample(worst.limit(0), targets).count() == 0
    assert resampled(resampling.resample(worst, targets.limit(0))) == drawn_plainly(plain, [])


def test_kth_values_over_the_whole_range_of_longs(spark):
    rng = random.Random(3)
    values = [rng.choice([-(2**63), 2**63 - 1, 0, 1, rng.randint(-9, 9), rng.randint(-(2**62), 2**62)]) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 57, 100, 199, 200):
        value, below = resampling.kth_value(rows, "v", k)
        assert value == sorted(values)[k - 1] and below == sum(v < value for v in values)


def test_runs_of_words_are_features():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abC 1-é漢\n") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for longest in (1, 2, 3):
        for text, (n, found) in zip(texts, resampling.buckets_of([t.encode() for t in texts], longest), strict=True):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.replace("C", "c"))
            assert n == len(words)
            assert found.tolist() == [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def test_crc_of_words_of_any_length():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    ends = np.cumsum([len(w) for w in words])
    assert resampling.crc32_of(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]


def test_op12_agrees_with_sql(spark, duck):
    assert multiset(queries.op12_fill_middle(spark, SF).toPandas()) == multiset(duck.execute(queries.ORACLES["op12_fill_middle"]).df())


def test_stops_count_units_as_the_pattern_does():
    rng, stops = random.Random(2), fill_middle.automaton()
    for _ in range(5000):
        text = "".join(rng.choice("ab \n\x0b<P>SM😀é \x1c") for _ in range(rng.randint(0, 30)))
        units = [m.end() for m in TOKEN.finditer(text)]
        ends, n, marked = fill_middle.word_ends(text, stops)
        assert n == len(units) and ends.tolist() == units[: len(ends)] and marked == any(s in text for s in ("<P>", "<S>", "<M>"))


def test_cut_texts_are_restored_whatever_they_hold(spark, worst):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab <>PSM😀é\n") for _ in range(rng.randint(1, 25))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = fill_middle.fill_middle(docs, percent=100, spm_percent=50).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == texts[r.doc_id] for r in rows)
    assert {r.form for r in rows} == {"plain", "spm", "psm"} and all((r.form == "plain") == any(s in texts[r.doc_id] for s in ("<P>", "<S>", "<M>")) for r in rows)
    found = fill_middle.fill_middle(worst, percent=100)
    assert found.count() == worst.count() and found.filter("doc_id is null").count() == worst.filter("doc_id is null").count()
    assert Counter((r.form, r.n) for r in found.filter("output = ''").collect()) == {("plain", 0): worst.filter("coalesce(text, '') = ''").count()}
    assert fill_middle.fill_middle(worst.limit(0)).count() == 0


def base_plainly(text):
    found = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            twice = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
            if (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and twice % 10 == 0, 10 <= len(digits) <= 15)[kind]:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans_agree_with_plain_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("0123456789 -.+()@ab%_:\n" if rng.random() < 0.5 else "01.@+ ") for _ in range(rng.randint(0, 60)))
        assert sorted((s for s, holds in personal_data.base_matches(text) if holds), key=lambda s: (s[1], s[0])) == base_plainly(text)


def test_op13_keeps_base_spans_and_adds_what_they_miss(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.op13_personal_data(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = base_plainly(texts[r.doc_id])
        line = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
        assert spans == sorted(spans, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))
    assert sum(len(r.spans.split(",")) for r in rows if r.spans) < 1.1 * sum(len(base_plainly(t)) for t in texts.values())


@pytest.fixture(scope="module")
def model(spark):
    """Trained on texts that each hold one span or one number that is none."""
    rng = random.Random(9)
    texts = []
    for i in range(1200):
        card = "".join(rng.choice("0123456789") for _ in range(15))
        check = next(d for d in "0123456789" if personal_data.luhn(card + d))
        other = str((int(check) + rng.randint(1, 9)) % 10)
        held = (f"u{i}@mail{i % 7}.example.org", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{i % 256}.7", card + check, card + other, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"in {rng.randint(1000, 99999)} of {rng.randint(10, 999)}")[i % 6]
        texts.append(f"some words {'and ' * rng.randint(0, 5)}before {held} after{rng.choice(['.', ' it', ' and more'])}")
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_trees_find_what_the_base_rules_lose(spark, model):
    texts, docs = model
    forest = personal_data.train(docs)
    one, two = "4539148803436467", "4485275742308327"
    assert personal_data.luhn(one) and personal_data.luhn(two)

    def found(text):
        base = [s for s, holds in personal_data.base_matches(text) if holds]
        return {text[a:b] for _, a, b in personal_data.added(text, base, forest)}

    assert found(f"some words before {one} {two} after it") == {one, two}
    assert found("some words before +1 (234) 555-6789 10.20.30.40 after it") == {"+1 (234) 555-6789"}
    assert found("some words before joe.doe (at) mail3 (dot) example (dot) org after it") == {"joe.doe (at) mail3 (dot) example (dot) org"}
    clean = [f"some words and {n} more of {n + 7} before it, at the dot." for n in range(100, 3000, 7)] + [t for t in texts if not base_plainly(t)]
    assert sum(bool(found(t)) for t in clean) <= len(clean) // 100


def test_redacted_texts_hold_no_base_span(spark, model):
    _, docs = model
    for r in personal_data.personal_data(docs).join(docs, "doc_id").collect():
        assert not base_plainly(personal_data.redacted(r.text, r.spans))


def test_worst_rows_of_personal_data(spark, worst):
    rows = personal_data.personal_data(worst).collect()
    assert len(rows) == worst.count()
    plain = Counter((r.doc_id, ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base_plainly(r.text or ""))) for r in worst.collect())
    assert Counter((r.doc_id, r.base) for r in rows) == plain
    assert personal_data.personal_data(worst.limit(0)).count() == 0


def test_patterns_take_linear_time():
    for part in ("1", "1.", "1 ", "a", "@", "a@", "+1", "+1 ", "(1) ", "a at b dot ", ". "):
        text = part * ((1 << 16) // len(part))
        assert sum(1 for _ in personal_data.base_matches(text)) <= len(text)
        assert sum(1 for _ in personal_data.proposals(text)) <= 19 * len(text)


def test_trees_learn_a_step_and_thresholds_keep_precision():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (2000, personal_data.FEATURES))
    x[:, 0] = 2
    y = ((x[:, 5] > 0.5) & (x[:, 9] < 0.7)).astype(int)
    forest = personal_data.fit(x, y, np.arange(2000) % 4 == 0)
    fresh = rng.uniform(0, 1, (1000, personal_data.FEATURES))
    truth = (fresh[:, 5] > 0.5) & (fresh[:, 9] < 0.7)
    assert ((forest.scores(fresh) > 0.5) == truth).mean() > 0.98
    assert forest.thresholds[2] <= 1 and forest.thresholds[0] == 2
    assert personal_data.threshold(np.array([0.99, 0.98, 0.97, 0.5]), np.array([1, 1, 0, 0])) == pytest.approx(0.975)
    assert personal_data.threshold(np.array([0.99]), np.array([0])) == 2
    assert personal_data.fit(x, np.ones(2000, int), np.arange(2000) % 4 == 0) is None


def test_op13_learns_from_every_proposal_of_every_text(spark):
    texts = [f"write to u{i % 7}@mail.org or call {i} of 10.0.0.{i % 300} today" for i in range(7000)] + [" and ".join(f"a{i}@b.example.org" for i in range(200)), None, ""]
    counted = personal_data.counted_examples(spark.createDataFrame([(t,) for t in texts], "text string")).df.collect()
    plain = Counter((label, np.array(x, np.int16).tobytes()) for t in texts for label, x in personal_data.examples(t or ""))
    found = Counter()
    for r in counted:
        found[r.label, bytes(r.x)] += r.n
    assert found == plain and sum(found.values()) > 14200


def test_trees_are_the_same_from_sums_of_tasks(spark, model, monkeypatch):
    monkeypatch.setattr(personal_data, "TREES", 3)
    one = personal_data.train(model[1])
    monkeypatch.setattr(personal_data, "BROADCAST_BYTES", 0)
    two = personal_data.train(model[1])
    for name in ("feature", "edge", "leaf", "start", "thresholds"):
        assert np.array_equal(getattr(one, name), getattr(two, name))
