"""Quality rules: robust multivariate outliers. DataFrame operations only.

Every text becomes a vector of transformed statistics. For each (lang, source), each lang and
all rows a minimum-covariance-determinant estimate is fitted: from several starts, one by
medians and median deviations and others by a few rows of least hash, concentration steps take
the mean and covariance of the SHARE of rows that are nearest under the last estimate. After
FIRST_STEPS of them the start of least determinant goes on. Each further step must lower the
group's determinant by a least factor; at the first that doesn't, the group keeps the better of
the two estimates and leaves the loop. Pivots have floors, so this ends. A group's estimate is
pooled with its language's, and that with the whole's, by numbers of rows, so a group of any
size is judged. A document goes if its squared Mahalanobis distance, made consistent for normal
data, exceeds the chi-square quantile.

A step is one pass: counts, sums and products are added up by group and bin of distance, with
combination before the shuffle, and the nearest SHARE are the first bins, the last of them in
part. So a source that holds a third of all rows loads no single task. Pivots of the covariance's Cholesky factor have floors,
as statistics that are constant in clean text, such as a share of symbols that is nearly always 0,
would give a singular estimate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.staging import BROADCAST_BYTES, Staged, let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words in a window of which repeats are counted.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Rows nearest to the centre that an estimate uses.
SHARE = 0.75
STARTS = 3
#: Rows of a start by hash, about.
START_ROWS = 16
FIRST_STEPS = 2
#: A group's steps end with the one by which the logarithm of its determinant doesn't fall by more.
SETTLED = 0.01
#: Rows that a language's estimate weighs in its groups', and that of all rows in a language's.
POOL = 200
#: Standard deviations, given the statistics before, below which a statistic's spread isn't taken to shrink. No base rule looks at repeated lines, so a share near 1 alone must pass CUTOFF.
FLOOR_SD = (0.6, 0.06, 0.2, 0.4, 0.3, 0.12, 0.15)
STATS = len(FLOOR_SD)
#: Share of normal data beyond the cutoff.
TAIL = 1e-6


def chi_square_tail(x: float, degrees: int) -> float:
    """Share of the chi-square distribution beyond x, for odd degrees."""
    total, term = 0.0, math.sqrt(x)
    for k in range(1, degrees - 1, 2):
        total += term
        term *= x / (k + 2)
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 / math.pi) * math.exp(-x / 2) * total


def chi_square_quantile(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > tail else (low, middle)
    return low


CUTOFF = chi_square_quantile(TAIL, STATS)
#: By how much the covariance of the nearest SHARE of normal rows falls short of that of all.
CONSISTENCY = SHARE / (1 - chi_square_tail(chi_square_quantile(1 - SHARE, STATS), STATS + 2))


def repeated_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the array.

    Window hashes are sorted with their positions and compared with their neighbours, so the
    cost is n log n; texts without a repeat stop after one pass through a hash set.
    """

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, count))


def characters(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.translate(text, of, ""))


def base_statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, the base rules' verdict, and the statistic vector x."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", "lang", "source", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = read.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        characters(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("text", r"[\p{L}\s]+", "")).alias("n_other"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.array(*transformed()).alias("x"),
    )


def transformed() -> list[Column]:
    """Logarithms of counts; inverse hyperbolic sines of shares, which are near linear at 0."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda part, whole, scale: F.asinh(scale * F.col(part) / whole)
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        share("n_symbols", chars, 50),
        share("n_repeat_words", words, 10),
        share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)), 10),
        share("n_upper", chars, 10),
        share("n_other", chars, 10),
    ]


def _ranked(values: DataFrame, keys: list[str], value: str, width: float, share: float, name: str) -> DataFrame:
    """For each key the upper edge of the bin in which the given share of its values is reached.

    Rows are counted by (key, bin) before the window, which sees one row a bin.
    """
    bins = values.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(*keys)
    up_to = F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    reached = bins.withColumn("reached", up_to >= share * F.sum("n").over(by)).filter("reached")
    return reached.groupBy(*keys).agg(((F.min("bin") + 1) * width).alias(name))


_PAIRS = [(i, j) for i in range(STATS) for j in range(i + 1)]
_MOMENTS = ["n", *[f"s{i}" for i in range(STATS)], *[f"s{i}_{j}" for i, j in _PAIRS]]


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) if terms else "0.0D"


def _squared_distance() -> Column:
    """|whitening (x - centre)|^2; whitening is the inverse Cholesky factor's lower triangle, row by row."""
    rows = [_sum([f"whitening[{i * (i + 1) // 2 + j}] * (x[{j}] - centre[{j}])" for j in range(i + 1)]) for i in range(STATS)]
    return F.expr(_sum([f"pow({row}, 2)" for row in rows]))


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    sums = ["count(1) AS n", *[f"sum(x[{i}]) AS s{i}" for i in range(STATS)], *[f"sum(x[{i}] * x[{j}]) AS s{i}_{j}" for i, j in _PAIRS]]
    return rows.groupBy(*by).agg(*map(F.expr, sums))


def _covered(sums: DataFrame, *keys: str) -> DataFrame:
    """n, centre (array) and scatter (the covariance's lower triangle, row by row) from sums."""
    centre = ", ".join(f"s{i} / n" for i in range(STATS))
    scatter = ", ".join(f"s{i}_{j} / n - s{i} / n * (s{j} / n)" for i, j in _PAIRS)
    return sums.selectExpr(*keys, "n", f"array({centre}) AS centre", f"array({scatter}) AS scatter")


def _whitened(estimates: DataFrame) -> DataFrame:
    """estimates(scatter) with `whitening` and `log_det`; each pivot of the Cholesky factor is FLOOR_SD at least.

    Lower triangles are arrays, row by row, each value made of those before it.
    """
    listed = lambda values: f"array({', '.join(map(repr, values))})"
    row, column = f"get({listed([i for i, _ in _PAIRS])}, p)", f"get({listed([j for _, j in _PAIRS])}, p)"
    places, floor = listed(range(len(_PAIRS))), listed([v**2 for v in FLOOR_SD])
    at = lambda array, i, j: f"get({array}, cast({i} * ({i} + 1) / 2 AS INT) + {j})"
    over = lambda condition, term: f"aggregate(filter({listed(range(STATS))}, k -> {condition}), 0.0D, (s, k) -> s + {term})"
    filled = lambda array, value: f"aggregate({places}, cast(array() AS array<double>), ({array}, p) -> array_append({array}, {value}))"
    rest = f"(get(scatter, p) - {over(f'k < {column}', at('l', row, 'k') + ' * ' + at('l', column, 'k'))})"
    factor = filled("l", f"if({row} = {column}, sqrt(greatest({rest}, cast(get({floor}, {row}) AS DOUBLE))), {rest} / {at('l', column, column)})")
    dot = over(f"k >= {column} AND k < {row}", at("factor", row, "k") + " * " + at("w", "k", column))
    inverse = filled("w", f"if({row} = {column}, 1.0D, -({dot})) / {at('factor', row, row)}")
    log_det = f"aggregate({listed(range(STATS))}, 0.0D, (s, k) -> s + 2 * ln({at('factor', 'k', 'k')}))"
    return estimates.selectExpr("*", f"{factor} AS factor").selectExpr(*estimates.columns, f"{inverse} AS whitening", f"{log_det} AS log_det")


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: (g, start, n, centre, scatter, whitening, log_det) of the nearest SHARE of each group's rows; of the bin in which that ends all rows count in part, so that n is that share."""
    bins = rows.join(estimates.select("g", "start", "centre", "whitening"), "g").withColumn("bin", F.floor(16 * F.log(_squared_distance() + 1e-6)))
    sums = _sums(bins, "g", "start", "bin")
    by = W.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = SHARE * F.sum("n").over(by)
    near = sums.withColumn("part", F.least(F.lit(1.0), (share - before) / F.col("n"))).filter("part > 0")
    return _whitened(_covered(near.groupBy("g", "start").agg(*[F.sum(F.col(m) * F.col("part")).alias(m) for m in _MOMENTS]), "g", "start"))


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0 has medians and median deviations (without covariances), the others the moments of about START_ROWS rows by hash."""
    values = rows.select("g", F.posexplode("x").alias("k", "v"))
    centre = Staged(_ranked(values, ["g", "k"], "v", 1 / 64, 0.5, "m")).for_join(200)
    apart = values.join(centre, ["g", "k"]).select("g", "k", F.abs(F.col("v") - F.col("m")).alias("d"))
    spread = _ranked(apart, ["g", "k"], "d", 1 / 64, 0.5, "mad").join(centre, ["g", "k"])
    parts = spread.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "m", F.pow(1.4826 * F.col("mad"), 2).alias("var")))).alias("p"))
    robust = parts.select("g", F.lit(0).alias("start"), F.transform("p", lambda e: e["m"]).alias("centre"), F.array(*[F.col("p")[i]["var"] if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("scatter"))
    sizes = Staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))).for_join(100)
    drawn = rows.join(sizes, "g").withColumn("start", F.ceil((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) * F.col("rows") / START_ROWS).cast("int")).filter(f"start between 1 and {STARTS - 1}")
    return robust.unionByName(_covered(_sums(drawn, "g", "start"), "g", "start").drop("n"))


def estimates(stats: DataFrame) -> Staged:
    """(g, n, centre, scatter, log_det) of every group of rows that pass the base rules.

    g is struct(lang, source, level): level 0 for a (lang, source), 1 for a lang, 2 for all rows.
    """
    none = F.lit(None).cast("string")
    group = lambda lang, source, level: F.struct(lang.cast("string").alias("lang"), source.cast("string").alias("source"), F.lit(level).alias("level"))
    levels = F.array(group(F.col("lang"), F.col("source"), 0), group(F.col("lang"), none, 1), group(none, none, 2))
    rows = Staged(stats.filter(~F.col("base_failed")).select("x", F.xxhash64("doc_id", "x").alias("h"), F.explode(levels).alias("g")))
    current = Staged(_whitened(_starts(rows.df)))
    small = current.rows() * 1200 <= BROADCAST_BYTES
    hinted = lambda df: F.broadcast(df) if small else df
    for step in range(FIRST_STEPS):
        found = _concentrated(rows.df, hinted(current.df))
        if step + 1 == FIRST_STEPS:
            least = F.row_number().over(W.partitionBy("g").orderBy("log_det", "start"))
            found = found.withColumn("place", least).filter("place = 1").drop("place")
        after = Staged(found)
        current.drop()
        current = after
    columns, going, settled, steps = ["n", "centre", "scatter", "whitening", "log_det"], current.df, [], [current]
    while not going.isEmpty():
        after = _concentrated(rows.df, hinted(going)).select("g", F.struct(*columns).alias("new"))
        both = going.select("g", "start", F.struct(*columns).alias("old")).join(after, "g", "left")
        fell = F.coalesce(F.col("old.log_det") - F.col("new.log_det"), F.lit(0.0))
        kept = F.when(fell > 0, F.col("new")).otherwise(F.col("old"))
        steps.append(Staged(both.select("g", "start", kept.alias("e"), (fell > SETTLED).alias("moves")).select("g", "start", "e.*", "moves")))
        settled.append(steps[-1].df.filter("not moves").drop("moves"))
        going = steps[-1].df.filter("moves").drop("moves")
    fitted = Staged(reduce(DataFrame.unionByName, settled, going))
    for table in (rows, *steps):
        table.drop()
    return fitted


def pooled(groups: DataFrame, fitted: DataFrame) -> DataFrame:
    """groups(lang, source) with centre and whitening: the group's estimate, its language's and the whole's, pooled by rows."""
    of = lambda level, name: fitted.filter(F.col("g.level") == level).select(F.col("g.lang").alias(f"{name}_lang"), F.col("g.source").alias(f"{name}_source"), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "centre", "scatter")])
    joined = (
        groups.join(of(0, "own"), F.col("lang").cast("string").eqNullSafe(F.col("own_lang")) & F.col("source").cast("string").eqNullSafe(F.col("own_source")), "left")
        .join(of(1, "whole"), F.col("lang").cast("string").eqNullSafe(F.col("whole_lang")), "left")
        .join(F.broadcast(of(2, "every")), F.lit(True), "left")
    )

    def mixed(array: str, factor: float) -> str:
        upper = f"if(whole_n IS NULL, v, (whole_n * get(whole_{array}, k) + {POOL} * v) / (whole_n + {POOL}))"
        language = f"transform(every_{array}, (v, k) -> {upper})"
        return f"transform({language}, (v, k) -> {factor!r}D * if(own_n IS NULL, v, (own_n * get(own_{array}, k) + {POOL} * v) / (own_n + {POOL}))) AS {array}"

    both = joined.filter("every_n is not null").selectExpr("lang", "source", mixed("centre", 1.0), mixed("scatter", CONSISTENCY))
    return _whitened(both).drop("scatter", "log_det")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, squared distance and final verdict of every row of docs(doc_id, text, lang, source).

    Null texts have no words and fail the base rule; null lang or source form groups of their
    own. The distance is null only where no row at all passes the base rules. Repeated rows are
    judged alike. Other columns are ignored, an empty table gives an empty result.
    """
    stats = Staged(base_statistics(docs))
    fitted = estimates(stats.df)
    groups = Staged(pooled(stats.df.select("lang", "source").distinct(), fitted.df))
    fitted.drop()
    own = groups.for_join(800).select(F.col("lang").alias("own_lang"), F.col("source").alias("own_source"), "centre", "whitening")
    judged = stats.df.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
    judged = judged.withColumn("distance", _squared_distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance", 3).alias("distance"))
