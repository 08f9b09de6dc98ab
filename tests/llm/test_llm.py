"""Every operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import asof, chat, components, exact_dedup, lm_scoring, mixing, packing, quality_rules, queries, simhash, substring_dedup, toxicity, warc, wordbytes
from lodestone.llm.staging import Staged
from tests.conftest import SF, multiset

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


def words(text):
    return (text or "").encode().split()


WORST = [None, "", "   \n\t", "one", "one two three", "x " * 300, "x " * 300, "long " * 20, "y\x0bz\r\nq", "Ünï cödé 漢字", "a b c d e f g h i j k l m n o p", "q a b c d e f g h i j k l m n o p", "#$%|<>", "one"]


@pytest.fixture(scope="module")
def worst(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None) for i, t in enumerate(WORST)]
    rows += [rows[3], rows[9], (None, "one", None, None, 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    for name in ("key", "norm", "target", "of", "rank", "range", "g", "x", "size", "words", "fp", "seg", "kind", "score", "held_out", "part"):
        df = df.withColumn(name, F.lit("clash"))
    return df


OPERATORS = {
    "op1": exact_dedup.exact_dedup,
    "op2": quality_rules.quality_verdicts,
    "op3": lambda d: lm_scoring.score(d, d.filter("doc_id = 9")),
    "op4": substring_dedup.remove_repeats,
    "op5": packing.packed,
    "op6": lambda d: toxicity.score(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
    "op7": simhash.near_duplicates,
    "op10": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_worst_rows_are_all_answered(spark, worst, name):
    got = OPERATORS[name](worst)
    assert got.count() == worst.count()
    assert OPERATORS[name](worst.limit(0)).count() == 0


def test_worst_rows_in_stages(spark, worst):
    labels = spark.createDataFrame([(0, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.accepted(worst, labels).columns == worst.columns
    for stage in (exact_dedup.kept_documents, simhash.representatives, mixing.curriculum):
        assert stage(worst).columns == worst.columns
        assert stage(worst.limit(0)).count() == 0
    assert exact_dedup.kept_documents(worst).filter("text = 'one'").count() == 1


@pytest.mark.parametrize(("capacity", "key_bits"), [(1 << 17, 64), (10, 64), (1000, 3)])
def test_exact_dedup_agrees_with_sql_at_any_bucket_and_key_size(spark, duck, capacity, key_bits):
    got = exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"), capacity, key_bits).toPandas()
    assert multiset(got) == multiset(duck.execute(queries.ORACLES["op1_exact_dedup"]).df())


def test_buckets_split_until_they_fit(spark):
    index = exact_dedup.build_index(spark.read.parquet(f"{SF}/documents.parquet"), 10)
    sizes = index.buckets.df.groupBy("bucket").count()
    assert index.slots.rows() == 2**index.depth and index.slots.df.select("bucket").distinct().count() == sizes.count()
    assert index.depth > 5 and sizes.agg(F.max("count")).first()[0] <= 10


def base(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(w), len(re.sub(r"[\x20\x09-\x0D]", "", text or ""))
    return n, chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_base_statistics(spark, worst):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(worst.select("doc_id", "text", "lang", "source", "n_chars"))
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(base(r.text))
    for r in quality_rules.base_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in texts[r.doc_id]


def plain_whitening(scatter):
    """Inverse Cholesky factor with floors on its pivots, and the logarithm of the determinant."""
    low = np.zeros((7, 7))
    for i in range(7):
        for j in range(i + 1):
            rest = scatter[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(rest, quality_rules.FLOOR_SD[i] ** 2)) if i == j else rest / low[j, j]
    return np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()


def plain_step(x, centre, white):
    """Weighted mean and covariance of the nearest SHARE under an estimate, by bins of distance, the last one in part."""
    d = ((white @ (x - centre).T) ** 2).sum(0)
    bins = np.floor(16 * np.log(d + 1e-6))
    weight, left = np.zeros(len(x)), quality_rules.SHARE * len(x)
    for v in np.unique(bins):
        mine = bins == v
        weight[mine] = min(1.0, max(0.0, left / mine.sum()))
        left -= mine.sum()
    mean = weight @ x / weight.sum()
    scatter = (x * weight[:, None]).T @ x / weight.sum() - np.outer(mean, mean)
    return weight.sum(), mean, scatter, *plain_whitening(scatter)


def plain_upper_edge(values):
    bins = np.sort(np.floor(values * 64))
    return (bins[math.ceil(0.5 * len(bins)) - 1] + 1) / 64


def plain_fit(x, h):
    """The estimate of one group's rows from its starts on, and the number of steps."""
    middle = np.array([plain_upper_edge(c) for c in x.T])
    spread = np.array([plain_upper_edge(np.abs(c - m)) for c, m in zip(x.T, middle, strict=True)])
    starts = [(middle, np.diag((1.4826 * spread) ** 2))]
    drawn = np.ceil((h % (1 << 30)) / (1 << 30) * len(x) / quality_rules.START_ROWS)
    for k in range(1, quality_rules.STARTS):
        some = x[drawn == k]
        if len(some):
            starts.append((some.mean(0), some.T @ some / len(some) - np.outer(some.mean(0), some.mean(0))))
    found = []
    for centre, scatter in starts:
        white = plain_whitening(scatter)[0]
        for _ in range(quality_rules.FIRST_STEPS):
            e = plain_step(x, centre, white)
            centre, white = e[1], e[3]
        found.append(e)
    best, steps = min(found, key=lambda e: e[4]), 0
    while True:
        after, steps = plain_step(x, best[1], best[3]), steps + 1
        fell = best[4] - after[4]
        best = after if fell > 0 else best
        if fell <= quality_rules.SETTLED:
            return best, steps


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_verdicts_agree_with_numpy_from_the_rows_and_every_group_settles(spark, monkeypatch, sf):
    steps, real = [], quality_rules._concentrated
    monkeypatch.setattr(quality_rules, "_concentrated", lambda *a: steps.append(1) or real(*a))
    docs = spark.read.parquet(f"{SF.removesuffix('sf0.01')}{sf}/documents.parquet")
    stats = quality_rules.base_statistics(docs).withColumn("h", F.xxhash64("doc_id", "x")).toPandas()
    good = stats[~stats.base_failed]
    fits = {}
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        for name, rows in good.groupby(keys) if keys else [((), good)]:
            fits[level, name] = plain_fit(np.stack(rows.x.to_numpy()), rows.h.to_numpy())
    got = quality_rules.quality_verdicts(docs).toPandas().set_index("doc_id")
    assert len(steps) == quality_rules.FIRST_STEPS + max(n for _, n in fits.values()) < 25
    mix = lambda own, upper: upper if own is None else (own[0], *((own[0] * a + quality_rules.POOL * b) / (own[0] + quality_rules.POOL) for a, b in zip(own[1:3], upper[1:3], strict=True)))
    get = lambda *key: fits.get(key, (None,))[0]
    wrong = 0
    for (lang, source), rows in stats.groupby(["lang", "source"]):
        pool = mix(get(0, (lang, source)), mix(get(1, (lang,)), get(2, ())))
        white, _ = plain_whitening(quality_rules.CONSISTENCY * pool[2])
        d = ((white @ (np.stack(rows.x.to_numpy()) - pool[1]).T) ** 2).sum(0)
        kept = ~rows.base_failed.to_numpy() & (d <= quality_rules.CUTOFF)
        wrong += int((got.loc[rows.doc_id, "kept"].to_numpy() != kept).sum())
        assert np.allclose(got.loc[rows.doc_id, "distance"], d, rtol=1e-3, atol=2e-3)
    assert wrong == 0


def test_quantiles_of_chi_square():
    assert quality_rules.chi_square_quantile(0.25, 7) == pytest.approx(9.037, abs=1e-3)
    assert quality_rules.chi_square_quantile(1e-4, 7) == pytest.approx(29.878, abs=1e-3)
    assert quality_rules.chi_square_tail(9.037, 9) == pytest.approx(0.434, abs=1e-3)


def test_groups_of_any_size_are_judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    judged = quality_rules.quality_verdicts(docs).join(labels, "doc_id", "left").toPandas()
    assert judged.distance.notna().all()
    assert (judged.kept == (~judged.base_failed & (judged.distance <= quality_rules.CUTOFF))).all()
    share = judged[~judged.base_failed].groupby("quality").kept.mean()
    assert share[1] > 0.98 and share[0] < 0.1
    few = quality_rules.quality_verdicts(docs.limit(30)).toPandas()
    assert len(few) == 30 and few.distance.notna().all()


def test_repeated_lines_alone_reject_a_text(spark):
    """Lines of one word in changing order: nearly all lines repeat, hardly a window of five words does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(3)
    common = Counter(w for r in docs.filter("lang = 'en'").limit(50).collect() for w in r.text.split() if w.isalpha() and w.islower())
    menu = [w for w, _ in common.most_common(60) if 4 <= len(w) <= 8][:12]
    text = "\n".join(rng.choice(menu) for _ in range(150))
    made = spark.createDataFrame([(-1, text, "en", docs.filter("lang = 'en'").first().source)], docs.schema)
    row = quality_rules.quality_verdicts(docs.unionByName(made)).filter("doc_id = -1").first()
    assert row.n_dup_lines > 0.9 * 150 and not row.base_failed and not row.kept, row


def plain_losses(texts, targets, asked):
    """Mean losses of the asked documents, by counting: sides apart, the document's own words left out, the larger side scaled down."""
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in enumerate(texts):
        k = 0 if i in targets else 1
        uni[k].update(t.split())
        bi[k].update(itertools.pairwise(t.split()))
    words_, pairs = uni[0] + uni[1], bi[0] + bi[1]
    vocabulary, kept = {w for w in words_ if words_[w] >= 2}, {p for p in pairs if pairs[p] >= 2}

    def contexts(u, b):
        left = Counter(u)
        for p, n in b.items():
            if p not in kept:
                left[p[0]] -= n
        return left

    totals = [sum(u.values()) for u in uni]
    scale = [min(totals) / t for t in totals] if min(totals) else [1, 1]
    context = [contexts(u, b) for u, b in zip(uni, bi, strict=True)]
    other = [sum(n for w, n in u.items() if w not in vocabulary) for u in uni]
    found = {}
    for i in asked:
        w = texts[i].split()
        side, u, b = (0 if i in targets else 1), Counter(w), Counter(itertools.pairwise(w))
        own_context, own_other = contexts(u, b), sum(n for v, n in u.items() if v not in vocabulary)

        def loss(k, before, v):
            mine = k == side
            seen = uni[k][v] - mine * u[v] if v in vocabulary else other[k] - mine * own_other
            p = (seen * scale[k] + 1) / ((totals[k] - mine * len(w)) * scale[k] + len(vocabulary) + 1)
            pair = (bi[k][before, v] - mine * b[before, v]) * scale[k] if (before, v) in kept else 0
            with_ = (context[k][before] - mine * own_context[before]) * scale[k] if before in vocabulary else 0
            return -math.log((pair + lm_scoring.PRIOR * p) / (with_ + lm_scoring.PRIOR))

        found[i] = [sum(loss(k, x, y) for x, y in zip([None, *w], w, strict=False)) / len(w) for k in (0, 1)] if w else None
    return found


def test_losses_agree_with_plain_counting(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c d e the of and".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = documents(spark, texts)
    for targets in (list(range(0, 60, 3)), []):
        got = {r.doc_id: r for r in lm_scoring.score(docs, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()}
        for i, means in plain_losses(texts, targets, range(60)).items():
            if means is None:
                assert got[i].score is None
            else:
                assert got[i].target_loss == pytest.approx(means[0]) and got[i].score == pytest.approx(means[0] - means[1])


@pytest.mark.parametrize("unit_words", [1 << 20, 1000])
def test_rare_words_and_bigrams_of_a_large_corpus_are_in_the_models(spark, monkeypatch, unit_words):
    """300,000 words, so that what occurs twice is far below 2^-17 of them; bigrams that occur once leave their context too."""
    monkeypatch.setattr(lm_scoring, "UNIT_WORDS", unit_words)
    monkeypatch.setattr(lm_scoring, "RANGE_WORDS", 16 * unit_words)
    monkeypatch.setattr(lm_scoring, "STEP_WORDS", unit_words // 3)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(1000)) for _ in range(300)] + ["rare own words w1 once", "w2 rare own words", "x own words rare w1"]
    targets = [*range(0, 300, 10), 300, 302]
    got = {r.doc_id: r for r in lm_scoring.score(documents(spark, texts), spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()}
    for i, means in plain_losses(texts, targets, (0, 1, 300, 301, 302)).items():
        assert got[i].target_loss == pytest.approx(means[0]) and got[i].background_loss == pytest.approx(means[1])
    assert len(got) == len(texts)


@pytest.mark.parametrize("segment", [2_000, 16 << 20])
def test_removed_words_agree_with_plain_search(spark, monkeypatch, segment):
    monkeypatch.setattr(substring_dedup, "SEGMENT_BYTES", segment)
    rng = random.Random(2)
    shared = [" ".join(str(rng.randint(0, 999)) for _ in range(n)) for n in (12, 13, 14, 60, 300)]
    texts = [" ".join([str(rng.random()) for _ in range(rng.randint(0, 30))] + rng.sample(shared, rng.randint(0, 3)) + [str(rng.random())]) for _ in range(60)] + [None, "", shared[4], shared[4]]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    first = {n: {} for n in (13, 26, 52, 104, 208, 416, 832)}
    for i, t in enumerate(texts):
        w = words(t)
        for n, seen in first.items():
            for p in range(len(w) - n + 1):
                seen.setdefault(tuple(w[p : p + n]), i)
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k for p in range(len(w) - 12) if first[13][tuple(w[p : p + 13])] < i for k in range(p, p + 13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert {k for s in got[i].spans for k in range(s.first, s.end)} == gone
        longest = max((n for n, seen in first.items() if any(seen[tuple(w[p : p + n])] < i for p in range(len(w) - n + 1))), default=None)
        assert got[i].longest == longest


def test_packing_holds_every_word_once_within_its_bin(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.packed(docs, (64, 256, 512)).collect()
    per_doc = defaultdict(list)
    per_bin = defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append((r.first_word, r.n_words))
        per_bin[r.bin].append((r.position, r.n_words, r.bin_length, r.bin_words))
    for d in docs.collect():
        spans = sorted(per_doc[d.doc_id])
        assert sum(n for _, n in spans) == len(words(d.text))
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans))
    for spans in per_bin.values():
        spans.sort()
        assert all(a + n <= b for (a, n, *_), (b, *_) in itertools.pairwise(spans))
        used = sum(n for _, n, *_ in spans)
        assert {s[2:] for s in spans} == {(min(c for c in (64, 256, 512) if c >= used), used)}


def plain_best_fit(sizes, opening, lengths):
    bins, to_come = [], sum(sizes)
    for s in sizes:
        fit = [b for b in bins if b[0] - b[1] >= s]
        if fit:
            room = min(b[0] - b[1] for b in fit)
            best = [b for b in fit if b[0] - b[1] == room][0]
        else:
            best = [min((c for c in opening if c >= s), key=lambda c: (packing.cost(c) / max(1, min(c, to_come)), c)), 0]
            bins.append(best)
        best[1] += s
        to_come -= s
    return sorted(min(c for c in lengths if c >= b[1]) for b in bins)


def test_pack_takes_the_cheapest_set_of_lengths():
    rng = random.Random(3)
    lengths = (64, 128, 256)
    for choices in ([0, 1, 5, 30, 64, 100, 250], [130, 140, 20], [60, 61, 62], [200]):
        sizes = sorted((rng.choice(choices) for _ in range(300)), reverse=True)
        found = [plain_best_fit(sizes, some, lengths) for some in ((256,), (64, 256), (128, 256), (64, 128, 256))]
        least = min(sum(map(packing.cost, f)) for f in found)
        got = sorted(packing.pack(sizes, lengths)[2])
        assert got in found and sum(map(packing.cost, got)) == pytest.approx(least)


def test_bins_are_nearly_full(spark):
    rows = packing.fill(packing.packed(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    assert sum(r.words for r in rows) > 0.98 * sum(r.bins * r.bin_length for r in rows) and len(rows) > 1


def test_toxicity_is_accurate_on_held_out_rows_and_unseen_endings(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    hit = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(wrong) < 0.01
    ids = {r.doc_id for r in rows}
    assert all((int(__import__("zlib").crc32(str(i).encode())) % 3) == 1 for i in ids)


def test_toxicity_embeds_what_ngrams_share(spark):
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(300)]
    bad = [" ".join([p, "vexo" + rng.choice(["ra", "ti", "num", "del"])]) for p in plain[:150]]
    texts = [f"{t} {rng.random()}" for t in bad + plain[150:]]
    labels = [(i, int(i < 150)) for i in range(300)] + [(160, 1), (200, None), (201, 7)]
    model = toxicity.train(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    s = toxicity.score_texts([b"alpha beta vexoshi gamma", b"alpha beta words gamma", b""], model.per_bucket(), model.offset())
    assert s[0] > 0.7 > s[1]
    assert toxicity.train(documents(spark, texts), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None


def test_scores_agree_with_plain_ngrams():
    """The score of a model by plain loops over words and n-grams, also across the slices' borders."""
    rng = random.Random(5)
    weights = np.random.default_rng(5).normal(0, 3, toxicity.BUCKETS).astype(np.float32)
    texts = [b"", b"a", b"\t one  two one\n", ("ñandú " * 3).encode(), " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 30))) for _ in range(9000)).encode(), b"x" * (3 * toxicity.GRAM_BYTES)]

    def bucket(gram):
        code = int.from_bytes(gram, "big") + (len(gram) << 56) & (1 << 64) - 1
        return int(toxicity.finish(np.array([code], np.uint64))[0]) & toxicity.BUCKETS - 1

    known = {}
    for text, got in zip(texts, toxicity.score_texts(texts, weights, 0.3), strict=True):
        each = []
        for word in text.split():
            if word not in known:
                marked = b"\x01" + word + b"\x02"
                found = [weights[bucket(marked[i : i + n])] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)] if len(set(word)) > 1 or len(word) < 99 else None
                if found is None:
                    ends = [marked[:n] for n in toxicity.GRAMS] + [marked[-n:] for n in toxicity.GRAMS]
                    inner = [(b"x" * n, len(word) - n + 1) for n in toxicity.GRAMS]
                    total = sum(float(weights[bucket(g)]) for g in ends) + sum(float(weights[bucket(g)]) * k for g, k in inner)
                    known[word] = total / (len(ends) + sum(k for _, k in inner))
                else:
                    known[word] = float(np.sum(found, dtype=np.float64)) / max(1, len(found))
            each.append(known[word])
        assert got == pytest.approx(1 / (1 + math.exp(-(0.3 + (sum(each) / len(each) if each else 0)))), rel=1e-4)


def test_scoring_a_block_of_distinct_words_takes_bounded_memory():
    rng = random.Random(6)
    text = " ".join("%010x" % rng.getrandbits(40) for _ in range(400_000)).encode()
    tracemalloc.start()
    toxicity.score_texts([text, b"y" * (4 << 20)], np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 4 << 20 and peak < 100 << 20, peak


def brute_components(texts):
    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(simhash._LOWER).split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in prints}


@pytest.mark.parametrize(("pairwise", "spread"), [(64, 1 << 20), (1, 1 << 20), (64, 2)])
def test_near_duplicates_agree_with_all_pairs(spark, monkeypatch, pairwise, spread):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "SPREAD", spread)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()} | {5000 + i: t for i, t in enumerate(WORST)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, list(texts.values()), list(texts))).collect()}
    assert got == brute_components(texts)


def test_long_texts_have_the_fingerprint_of_all_their_shingles():
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(200_000))
    for t in (text, "z" * (10 << 20), "z" * (1 << 20) + " a b " + "q" * (1 << 20)):
        w = t.split()
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))], np.uint64)
        ones = np.array([(hashes >> np.uint64(k) & np.uint64(1)).sum() for k in range(64)])
        assert int(simhash.fingerprints([t.encode()])[0]) == sum(1 << k for k in range(64) if 2 * ones[k] > len(hashes))


def test_hashes_of_words_do_not_depend_on_slices(monkeypatch):
    words_ = [bytes([97 + k % 7]) * n for k, n in enumerate((1, 5, 300, 7, 2000, 3, 64, 65, 63, 128, 1))]
    data, starts, ends, _ = wordbytes.boundaries([b" ".join(words_)])
    whole, pairs = wordbytes.word_hashes(data, starts, ends), None
    pairs = wordbytes.windows(whole, 2)
    monkeypatch.setattr(wordbytes, "SLICE_BYTES", 64)
    assert (wordbytes.word_hashes(data, starts, ends) == whole).all()
    long_ = np.arange(1000, dtype=np.uint64)
    assert (wordbytes.windows(whole, 2) == pairs).all() and len(np.unique(wordbytes.windows(long_, 13))) == 988


def test_chain_budgets_admit_every_pair_within_two_bits():
    rng = np.random.default_rng(5)
    left = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    right = left ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    admitted = np.zeros(3000, bool)
    for at in range(simhash.SEGMENTS):
        admitted |= simhash.chain_allows(left, right, np.full(3000, at))
    assert admitted.all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 7 for k in range(7, 40)}


def test_asof_joins_agree_with_plain_search_at_any_stretch(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randint(0, 50), rng.choice([None, rng.randint(0, 9)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v long, i long")
    for stretch in (1, 7, 1 << 16):
        for r in asof.latest_earlier(df, "k", "t", "v", stretch).collect():
            before = [(t, v) for k, t, v, _ in rows if k == r.k and k is not None and v is not None and t < r.t]
            assert r.latest == (max(before)[1] if before else None)


def test_revisits(spark, duck):
    got = queries.op8_warc_revisits(spark, SF).toPandas()
    assert multiset(got) == multiset(duck.execute(queries.ORACLES["op8_warc_revisits"]).df())
    schema = "record_id string, url string, time long, kind string, headers map<string,string>, payload binary, status string, latest string"
    rows = [
        ("a", "http://www.X.org:80/p/?utm_source=1&b=2&a=1#f", 1, "response", {"etag": "1", "server": "s", "content-type": "t"}, b"one", "", ""),
        ("b", "https://x.org/p?a=1&b=2", 2, "revisit", {"etag": "1", "server": "new", "date": "d", "content-length": "0"}, None, "", ""),
        ("c", "x.org/p?a=1&b=2", 3, "response", {"etag": "2"}, b"two", "", ""),
        ("d", "x.org/p?b=2&a=1", 4, "revisit", {"etag": "1"}, None, "", ""),
        ("e", "x.org/p?b=2&a=1", 4, "revisit", {}, None, "", ""),
        ("f", "x.org/q", 4, "revisit", {"etag": "1"}, None, "", ""),
        ("g", None, None, "revisit", None, None, "", ""),
    ]
    found = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.status for k, r in found.items()} == {"b": "resolved", "d": "changed", "e": "unvalidated", "f": "missing", "g": "missing"}
    assert found["b"].headers == {"etag": "1", "server": "s", "content-type": "t", "date": "d"} and bytes(found["b"].payload) == b"one" and found["b"].refers_to == "a"
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


def test_records_that_are_read_are_resolved(spark):
    one, two, gone = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00.5Z", "not a time"
    rows = [
        ("<u:1>", "response", "http://a/", one, {"etag": '"x"', "vary": "a"}, b"body"), ("<u:2>", "revisit", "http://a/", two, {"etag": '"x"', "warc-profile": warc.NOT_MODIFIED}, None),
        ("<u:3>", "revisit", "http://a/", one, {"etag": '"x"'}, None), ("<u:4>", "revisit", "http://a/", gone, {"etag": '"x"'}, None), (None, "response", None, None, {}, b""),
    ]
    content = b"".join(warc.write_record(*r) for r in rows)
    files = spark.createDataFrame([(content,), (gzip.compress(content),)], "content binary")
    found = warc.resolve(warc.read_records(files)).collect()
    assert Counter((r.record_id, r.status, r.refers_to, r.payload and bytes(r.payload)) for r in found) == {("<u:2>", "resolved", "<u:1>", b"body"): 2, ("<u:3>", "missing", None, None): 2, ("<u:4>", "missing", None, None): 2}
    times = lambda kind, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], "time string").select(F.col("time").cast(kind).alias("time")).select(warc.instant(spark.createDataFrame([], f"time {kind}"))).collect()]
    assert times("string", "7", one, gone, None) == [7, 1704067200000000, None, None] and times("timestamp", one) == [1704067200000000] and times("int", "5") == [5]
    again = [(i, c) for i, c in enumerate(warc.archived(warc.read_records(files)).collect())]
    assert Counter(r[0] for _, c in again for r in warc.parse(bytes(c.content))) == {"<u:1>": 2, "<u:2>": 2, "<u:3>": 2, "<u:4>": 2, None: 2}


def test_headers_of_one_name_are_joined_and_folded_ones_unfolded():
    assert warc._headers(b"Vary: a\r\nvary: b,\r\n  c\r\nX: 1:2\r\njunk") == {"vary": "a, b, c", "x": "1:2"}


def test_damaged_files_give_what_is_before_the_damage():
    records = [warc.write_record(f"r{k}", "response", f"http://a/{k}", "2020", {"etag": "x"}, b"body" * 500) for k in range(3)]
    plain, packed = b"".join(records), b"".join(gzip.compress(r) for r in records)
    assert [r[0] for r in warc.parse(packed)] == ["r0", "r1", "r2"] == [r[0] for r in warc.parse(plain)]
    assert [r[0] for r in warc.parse(packed[:-20])] == ["r0", "r1"] == [r[0] for r in warc.parse(plain[:-20])]
    garbled = bytearray(packed)
    garbled[len(gzip.compress(records[0])) + 3] ^= 0xFF
    garbled[-60] ^= 0xFF
    assert [r[0] for r in warc.parse(bytes(garbled))][:1] == ["r0"]
    negative = records[0].replace(b"Content-Length: ", b"Content-Length: -", 1)
    assert [r[0] for r in warc.parse(negative + records[1])] == ["r1"] and list(warc.parse(b"\x1f\x8bxx")) == []


def test_revisits_of_other_profiles_are_not_resolved(spark):
    columns = "record_id string, url string, time long, kind string, headers map<string,string>, payload string"
    revisit = lambda i, profile: (i, "http://a/", 5, "revisit", {"etag": "x"} | ({"warc-profile": profile} if profile else {}), None)
    rows = [("f", "http://a/", 1, "response", {"etag": "x"}, "p"), revisit("a", None), revisit("b", "http://netpreserve.org/warc/1.1/revisit/server-not-modified"), revisit("c", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    assert {r.record_id: r.status for r in warc.resolve(spark.createDataFrame(rows, columns)).collect()} == {"a": "resolved", "b": "resolved", "c": "other"}


def test_warc_round_trip(spark):
    import gzip

    rows = [("<u:1>", "response", "http://a/", "2024-01-01T00:00:00Z", {"etag": '"x"'}, b"body\r\n\r\nmore"), ("<u:2>", "revisit", "http://a/", "2024-01-02T00:00:00Z", {"etag": '"x"', "warc-profile": warc.NOT_MODIFIED}, None)]
    content = b"".join(warc.write_record(*r) for r in rows)
    files = spark.createDataFrame([(content,), (gzip.compress(content),), (None,), (b"junk\nWARC/1.1\r\n\r\n",)], "content binary")
    got = [(r.record_id, r.kind, r.url, r.time, r.headers, r.payload and bytes(r.payload)) for r in warc.read_records(files).collect()]
    assert got == rows * 2


def test_levels_agree_with_recursion(spark):
    rng = random.Random(3)
    needs = {(c, str(i)): [str(x) for x in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))] for c in (1, 2) for i in range(40)}
    needs |= {(3, "a"): ["b"], (3, "b"): ["a"], (3, "c"): ["a", "d"], (3, "d"): [], (3, "e"): ["zz"]}

    def level(n, seen=()):
        if n in seen:
            return None
        below = [level((n[0], x), (*seen, n)) for x in needs[n] if (n[0], x) in needs]
        return None if None in below else max(below, default=-1) + 1

    calls = spark.createDataFrame([(c, k, v) for (c, k), v in needs.items()], "conv_id long, call_id string, depends_on array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in chat.levels(calls).df.collect()} == {n: level(n) for n in needs}


def test_tool_calls(spark):
    schema = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, depends_on array<string>, level string, at string"
    rows = [
        (1, 0, "system", "be kind", None, None, None, None, "", ""),
        (1, 1, "call", None, "x", "answer", '{"words": 3, "question": "q"}', None, "", ""),
        (1, 2, "tool", "r", "x", None, None, None, "", ""),
        (1, 3, "tool", "again", "x", None, None, None, "", ""),
        (1, 4, "call", None, "x", "answer", "{}", None, "", ""),
        (1, 5, "call", None, "y", "answer", '{"words": "3", "other": 1, "question": "q"}', ["x"], "", ""),
        (1, 6, "call", None, "z", "nothing", "[1]", ["z"], "", ""),
        (1, 7, "tool", "?", "w", None, None, None, "", ""),
        (None, 1, "call", None, "x", "fly", '{"a":1}', None, "", ""),
        (None, None, None, None, None, None, None, None, "", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.link_tool_calls(spark.createDataFrame(rows, schema), chat.SCHEMAS).collect()}
    assert {k[1]: r.status for k, r in got.items() if k[0]} == {0: "message", 1: "linked", 2: "linked", 3: "duplicate", 4: "duplicate", 5: "unanswered", 6: "cycle", 7: "orphan"}
    assert (got[1, 1].level, got[1, 5].level, got[1, 6].level) == (0, 1, None)
    assert got[1, 1].violations == [] and got[1, 4].violations == ["missing question", "missing words"]
    assert got[1, 5].violations == ["type of words", "unexpected other"] and got[1, 6].violations == ["not an object"] and got[None, 1].violations == ["unknown tool"]
    assert got[1, 1].json == '{"arguments":{"question":"q","words":3},"call_id":"x","name":"answer","role":"call","turn":1}'
    assert chat.link_tool_calls(spark.createDataFrame([], schema), chat.SCHEMAS).count() == 0


def test_conversations_link_neighbouring_turns(spark):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in queries.op9_tool_calls(spark, SF).collect():
        role = turns[r.conv_id, r.turn].role
        before = turns.get((r.conv_id, r.turn - 1))
        after = turns.get((r.conv_id, r.turn + 1))
        if role == "user":
            assert r.status == ("linked" if after and after.role == "assistant" else "unanswered") and r.violations == ""
            assert json.loads(r.json)["arguments"]["question"] == turns[r.conv_id, r.turn].text
        elif role == "assistant":
            assert r.status == ("linked" if before and before.role == "user" else "orphan")


def test_mix_agrees_with_sql_at_any_range(spark, duck, monkeypatch):
    want = multiset(duck.execute(queries.ORACLES["op10_mixing"]).df())
    for rows in (1 << 12, 3):
        monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
        assert multiset(queries.op10_mixing(spark, SF).toPandas()) == want


def test_op10_rows_come_in_training_order(spark):
    """Positions found again by bisection of each source's integral, in md5 order within the source."""
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, len(words(r.text))))
    rows = queries.op10_mixing(spark, SF).collect()
    got = {r.doc_id: r for r in rows}
    position = {}
    for k, source in enumerate(sorted(lines)):
        tilt, begins = (-0.5, 0.0, 0.5)[k % 3], 0
        for _, i, size in sorted(lines[source]):
            low, high = 0.0, 1.0
            for _ in range(60):
                t = (low + high) / 2
                low, high = (t, high) if t + tilt * (t * t - t) < begins / got[i].target else (low, t)
            position[i] = low if got[i].taken else 2.0
            begins += size
    order = [position[r.doc_id] for r in rows]
    assert len(order) == len(position) and all(a <= b + 1e-9 for a, b in itertools.pairwise(order))
    assert 2.0 in order and len(set(order)) > len(order) / 2


def test_mix_meets_targets_and_schedules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in rows.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert rows.groupby("source").target.first().sum() == pytest.approx(rows["size"].sum())
    for tilt in (-0.5, 0.0, 0.5):
        t = spark.range(0, 101).select(mixing.time_of(F.col("id") / 100, F.lit(tilt)).alias("t"), (F.col("id") / 100).alias("s")).toPandas()
        assert np.allclose(t.t + tilt * (t.t**2 - t.t), t.s)
    copies = mixing.curriculum(docs).groupBy("doc_id").count()
    assert copies.join(mixing.mix(docs), "doc_id").filter(F.col("count") != F.col("copies")).count() == 0


def test_pipeline_keeps_clean_documents_and_drops_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        before = {r.doc_id: r for r in kept.collect()}
        ids = [r.doc_id for r in after.collect()]
        if name == "exact dedup":
            groups = defaultdict(set)
            for i, r in before.items():
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)].add(i)
            assert sorted(ids) == sorted(min(g) for g in groups.values())
        if name == "near dedup":
            want = brute_components({i: r.text for i, r in before.items()})
            assert sorted(ids) == sorted(i for i, (_, root) in want.items() if root == i)
        counts.append(len(ids))
        kept = spark.createDataFrame([r for r in after.collect()], docs.schema)
    assert counts[0] > 0.8 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.agg(F.sum("n_words")).first()[0] == kept.select(F.sum(mixing.words_of(F.col("text")))).first()[0]


def test_rows_that_share_a_doc_id_are_known_by_their_texts(spark):
    rows = [(None, "one two", "en", "a"), (None, "three four", "en", "a"), (1, "five six", "en", "a"), (1, "seven  eight", "en", "b"), (1, "seven eight", "en", "b"), (2, "five six", "en", "b"), (3, None, "en", None), (3, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, " ".join((r.text or "").split())) for r in kept.collect())
    assert found == [(0, "one two"), (0, "three four"), (1, "five six"), (1, "seven eight"), (3, "")]
    mixed = mixing.curriculum(docs.filter("source = 'a'").unionByName(docs.filter("source = 'a'")))
    counts = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and set(counts) == {(None, "one two"), (None, "three four"), (1, "five six")} and set(counts.values()) == {1}
