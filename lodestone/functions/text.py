"""Column functions over text: normalising, hints, forms, periods, previews, overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mean a causal statement, in the order in which they are counted.
CAUSAL = ("because", "due to", "as a result", "driven by", "primarily", "resulted in")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_lines(text: Column) -> Column:
    """Line ends unified, lines trimmed, empty ones dropped."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 3))), F.lit("...")))


def enriched(title: Column, hints: Column, body: Column, title_repeats: int = 2, hints_repeats: int = 3, limit: int = 65000) -> Column:
    """Title and hints repeated in front of the body, line by line; blank ones left out."""
    part = lambda c, n: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.array_repeat(F.trim(c), n)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(part(title, title_repeats), part(hints, hints_repeats), F.array(F.coalesce(body, F.lit(""))))
    return F.left(F.array_join(lines, "\n"), F.lit(limit))


def sentence_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[.!?](\s|$)"), F.lit(0)))


def causal_signals(text: Column) -> Column:
    return let(F.lower(text), lambda low: sum((low.contains(p).cast("int") for p in CAUSAL), F.lit(0)))


def trigrams(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"[ \t\n\r]+", "")
    return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


# Words that look like metric names and are none, and the pattern of such names.
HINT_NOISE = ("Restated", "Consolidated", "Financial", "Statements", "Reporting", "Accounting", "Standard", "Disclosure", "Document", "Securities", "Exchange", "Commission")
METRIC_NAME = r"\b[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\b"


def metric_hints(question: Column, limit: int = 12) -> Column:
    """CamelCase words of 8 letters or more, each once, the first `limit`."""
    found = F.regexp_extract_all(question, F.lit(f"(?U){METRIC_NAME}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 8) & ~w.isin(*HINT_NOISE))), 1, limit)


def form_base(form: Column) -> Column:
    """`10K`, `10.K`, `10-K/A` -> `10-K`."""
    bare = F.regexp_replace(F.upper(F.trim(form)), r"/A$", "")
    return F.regexp_replace(bare, r"^(10|8|20|6)[ .-]?([KQF])$", "$1-$2")


def period_dates(question: Column, limit: int = 8) -> Column:
    """Dates 20xx-mm-dd, each once, the first `limit`; letters of any script end a word."""
    return F.slice(F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?U)\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"), F.lit(1))), 1, limit)


def period_years(question: Column, limit: int = 6) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?U)\b(20[0-9]{2})\b"), F.lit(1))), 1, limit)


# What asks for a comparison, and for the newest.
YOY = ("year over year", "yoy", "同比", "去年同期")
QOQ = ("quarter over quarter", "qoq", "环比", "上一季度")
LATEST = r"(?U)\b(latest|most recent|newest)\b"
RECENT = r"(?U)\b(latest|most recent|newest|filed)\b"


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def compare_mode(question: Column) -> Column:
    """yoy, qoq, latest, point_in_time (a date is named) or generic; null counts as empty."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return (
        F.when(holds_any(q, YOY), "yoy")
        .when(holds_any(q, QOQ), "qoq")
        .when(q.rlike(LATEST) | holds_any(q, ("最新", "最近")), "latest")
        .when(F.size(period_dates(q)) > 0, "point_in_time")
        .otherwise("generic")
    )


def prefers_recent(question: Column) -> Column:
    """Whether the newest rows come first: always for latest and point_in_time, else where the words ask for it."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return compare_mode(question).isin("latest", "point_in_time") | q.rlike(RECENT) | holds_any(q, ("最新", "最近", "申报"))


def is_chinese(question: Column) -> Column:
    """4 Chinese characters, or 18 % of at least 10."""
    n = F.length(F.regexp_replace(question, r"[^\x{4e00}-\x{9fff}]", ""))
    return (n >= 4) | ((F.length(question) >= 10) & (n / F.length(question) >= 0.18))


def number_of(value: Column) -> Column:
    """A number or a numeric text with commas; null for truth values and others, and for nan and infinity."""
    bare = F.regexp_replace(F.trim(value), ",", "")
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def padded_cik(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik.cast("string"), "[^0-9]", ""), 10, "0")


def accession_year(accession: Column) -> Column:
    two = F.split(accession, "-")[1].try_cast("int")
    return F.when(two <= 30, 2000 + two).otherwise(1900 + two)


def basename(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)
