"""What a passage is and whether it can be cited: roles, topics, quality flags, sources. Columns over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import holds_any, let

# Names with the phrases that mean them; of roles the first that is met counts.
SECTION_ROLES = (
    ("results_of_operations", ("results of operations", "operating results", "operating income", "operating loss")),
    ("liquidity", ("liquidity and capital resources", "liquidity", "capital resources")),
    ("critical_accounting", ("critical accounting", "critical accounting policies")),
    ("market_risk", ("quantitative and qualitative disclosures about market risk", "market risk")),
    ("risk_factors", ("risk factors",)),
    ("restatement", ("restatement", "amended and restated", "temporary equity", "equity classification")),
    ("exhibits", ("exhibit", "certification", "sarbanes-oxley", "section 302", "section 906")),
    ("company_overview", ("blank check company", "business combination", "cayman islands exempted company")),
    ("mda", ("management's discussion and analysis", "management’s discussion and analysis", "md&a")),
)
TOPICS = (
    ("revenue", ("revenue", "revenues", "sales")),
    ("cost_of_revenue", ("cost of revenue", "costs of revenue", "cost of sales")),
    ("gross_profit", ("gross profit",)),
    ("gross_margin", ("gross margin",)),
    ("operating_expense", ("operating expenses", "general and administrative", "g&a", "administrative expenses")),
    ("operating_income", ("operating income", "operating loss", "operating results")),
    ("net_income", ("net income", "net loss")),
    ("liquidity", ("liquidity", "cash flows", "working capital", "capital resources")),
)
STATEMENTS = (
    ("balance_sheet", ("资产负债表", "合并资产负债表")),
    ("income_statement", ("利润表", "损益表", "合并利润表")),
    ("cash_flow_statement", ("现金流量表", "合并现金流量表")),
    ("equity_statement", ("所有者权益变动表", "股东权益变动表")),
    ("financial_notes", ("财务报表附注", "附注")),
    ("management_discussion", ("管理层讨论", "经营情况讨论", "md&a")),
)
METRICS = (
    ("revenue", ("营业收入", "收入", "营收", "revenue", "revenues")),
    ("net_profit", ("净利润", "归母净利润", "net income", "net loss")),
    ("gross_margin", ("毛利率", "gross margin")),
    ("cash_flow", ("现金流", "经营活动产生的现金流量净额", "cash flow")),
    ("accounts_receivable", ("应收账款",)),
    ("inventory", ("存货",)),
    ("assets", ("总资产", "资产总计")),
    ("liabilities", ("总负债", "负债合计")),
)
FINANCE = ("财务报表", "资产负债表", "利润表", "现金流量表", "年报", "季报", "招股说明书", "营业收入", "净利润")
EXPLAINS = ("due to", "primarily", "mainly", "driven by", "resulted from", "because", "increase in", "decrease in", "offset by")
INTRODUCES = (
    "table of contents",
    "item 2. management",
    "references to the company",
    "the following discussion and analysis should be read in conjunction with",
    "blank check company",
    "formed for the purpose of effecting a merger",
)
LOOKS_FORWARD = ("forward-looking statements", "cautionary note regarding forward-looking", "not historical facts", "could cause actual results to differ materially")
BOILERPLATE = (
    "table of contents",
    "references to the company",
    "forward-looking statements",
    "cautionary note regarding forward-looking",
    "item 2. management",
    "exhibit",
    "appendix",
    "blank check company",
    "formed for the purpose of effecting a merger",
)
HEADINGS = ("table of contents", "item 2.", "management's discussion and analysis", "management’s discussion and analysis", "references to the company", "forward-looking statements")
REFERS = (
    "incorporated by reference",
    "as discussed in part i, item 1a",
    "as discussed in part ii, item 1a",
    "under the heading “risk factors”",
    'under the heading "risk factors"',
    "see item 1a",
    "there have been no material changes to the company’s risk factors",
    "there have been no material changes to the company's risk factors",
)
ADVERTISES = ("微信", "qq", "电话", "手机号", "客服", "官网", "官微", "联系方式", "在线咨询", "私信", "留言", "机构", "老师", "招生老师", "报名指导", "报考指导", "辅导", "包过", "保过", "包上岸", "承诺", "内部名额", "名额")


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text holds any of the phrases, case aside."""
    return let(F.lower(text), lambda low: holds_any(low, phrases))


def first_named(text: Column, rules: tuple) -> Column:
    return F.coalesce(*[F.when(holds(text, phrases), F.lit(name)) for name, phrases in rules])


def all_named(text: Column, rules: tuple, limit: int) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(holds(text, phrases), F.lit(name)) for name, phrases in rules])), 1, limit)


def surface(title: Column, path: Column, text: Column, limit: int) -> Column:
    """Path, title and the beginning of the text in one line; what role rules look at."""
    return F.lower(F.trim(F.concat_ws(" ", F.concat_ws(" ", path), F.trim(title), F.trim(F.left(text, F.lit(limit))))))


def section_role(title: Column, path: Column, text: Column) -> Column:
    """The first rule met; `unknown` for a passage with a path or title, else null."""
    placed = (F.coalesce(F.size(path), F.lit(0)) > 0) | (F.coalesce(F.trim(title), F.lit("")) != "")
    return F.coalesce(first_named(surface(title, path, text, 1200), SECTION_ROLES), F.when(placed, "unknown"))


def leaf_role(title: Column, path: Column, text: Column) -> Column:
    """What a passage does in its section; null if there is nothing to look at."""
    seen = surface(title, path, text, 2000)
    section = F.coalesce(section_role(title, path, text), F.lit("unknown"))
    return (
        F.when(seen == "", None)
        .when(holds(seen, INTRODUCES), F.when(section.isin("mda", "results_of_operations"), "mda_intro").otherwise("boilerplate"))
        .when(section == "restatement", "restatement_note")
        .when(section.isin("results_of_operations", "liquidity") & holds(seen, EXPLAINS), F.when(section == "liquidity", "liquidity_driver").otherwise("results_driver"))
        .when(holds(seen, LOOKS_FORWARD), "forward_looking")
        .when(section.isin("results_of_operations", "liquidity"), "mda_intro")
        .when(section.isin("market_risk", "exhibits", "company_overview"), "boilerplate")
        .when(section == "risk_factors", F.when(F.length(seen) >= 200, "risk_factor_item").otherwise("boilerplate"))
        .otherwise("other")
    )


def topics(title: Column, path: Column, text: Column) -> Column:
    return all_named(surface(title, path, text, 2000), TOPICS, 12)


def domain(text: Column) -> Column:
    return F.when(holds(text, FINANCE), "finance").otherwise("generic")


def statement(text: Column) -> Column:
    return first_named(text, STATEMENTS)


def metric_names(text: Column) -> Column:
    return all_named(text, METRICS, 8)


def search_hints(*parts: Column) -> Column:
    """Texts and arrays of labels as one line, each label once, blank ones left out."""
    labels = F.transform(F.flatten(F.array(*parts)), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(labels, lambda x: x != "")), " ")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != "")


def _sentences(bare: Column, lines: Column) -> Column:
    ends = F.regexp_count(bare, F.lit(r"[.!?](\s|$)"))
    return let(ends, lambda n: F.when(n > 0, n).otherwise(F.size(F.filter(lines, lambda x: F.length(x) >= 60))))


def sentences(text: Column) -> Column:
    """Ends of sentences; where there are none, lines of 60 characters or more."""
    return F.coalesce(_sentences(F.trim(text), lines_of(text)), F.lit(0))


def citable(text: Column, explains: Column) -> Column:
    """score, blocked, flags, sentences and table_share of a passage; explains is its number of causal phrases. Null is empty.

    What several rules look at is computed once; phrases are looked for only where a rule still depends on them.
    """
    is_table = lambda x: F.lower(F.left(x, F.lit(7))) == "table |"
    total = lambda rows: F.aggregate(rows, F.lit(0), lambda a, x: a + F.length(x))

    def seen(bare: Column, low: Column, lines: Column) -> Column:
        n, tables = F.length(bare), total(F.filter(lines, is_table))
        return F.struct(
            n.alias("n"), F.size(lines).alias("lines"), _sentences(bare, lines).alias("ends"), tables.alias("tables"), total(lines).alias("all"),
            low.contains("table of contents").alias("contents"), ((n > 0) & ((n <= 420) | holds_any(low, HEADINGS))).alias("headed"), holds_any(low, REFERS).alias("refers"),
        )

    def judged(s: Column) -> Column:
        n, ends = s["n"], s["ends"]
        short, title = (n < 120) & (ends < 2), s["headed"] & (ends == 0) & (s["lines"] <= 4)
        return F.struct(
            n.alias("n"), ends.alias("ends"), (s["tables"] / F.greatest(n, F.lit(1))).alias("tables"), ((s["all"] - s["tables"]) / F.greatest(n, F.lit(1))).alias("told"), s["contents"].alias("contents"), short.alias("short"), title.alias("title"),
            (s["contents"] | short | title).alias("blocked"), s["headed"].alias("headed"), s["refers"].alias("refers"), (s["refers"] & (ends <= 2) & (explains == 0)).alias("only_refers"),
        )

    def scored(s: Column) -> Column:
        n, ends, tables, blocked, only_refers = s["n"], s["ends"], s["tables"], s["blocked"], s["only_refers"]
        other, heading = s["refers"] & ~only_refers, s["headed"] & (n < 500)
        scores = ((n >= 220, 0.8), (ends >= 2, 0.8), (s["told"] >= 0.6, 0.8), (ends == 0, -1.0), (tables >= 0.75, -0.8), (only_refers, -1.0), (other, -0.4), (heading, -0.4))
        score = sum((F.when(met & ~blocked, w).otherwise(0.0) for met, w in scores), F.lit(0.0))
        flags = (
            (s["contents"], "toc"), (s["short"], "too_short"), (s["title"], "heading_only"), (~blocked & (ends == 0), "no_sentence"), (~blocked & (tables >= 0.75), "table_heavy"),
            (~blocked & only_refers, "cross_ref_only"), (~blocked & other, "cross_ref"), (~blocked & heading, "heading_like"),
        )
        named = F.array_compact(F.array(*[F.when(met, F.lit(name)) for met, name in flags]))
        return F.struct(F.round(score, 4).alias("score"), blocked.alias("blocked"), named.alias("flags"), ends.alias("sentences"), F.round(tables, 4).alias("table_share"))

    return let(F.trim(F.coalesce(text, F.lit(""))), lambda bare: let(let(let(F.lower(bare), lambda low: let(lines_of(bare), lambda lines: seen(bare, low, lines))), judged), scored))


def answerable(text: Column, explains: Column, rerank: Column, least: float = 0.10) -> Column:
    """hard_blocked, and passed: no boilerplate, at least 120 characters, citable and reranked to `least`."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    blocked = holds(bare, BOILERPLATE) | (F.length(bare) < 120) | citable(text, explains)["blocked"]
    return F.struct(blocked.alias("hard_blocked"), (~blocked & (F.coalesce(rerank, F.lit(0.0)) >= least)).alias("passed"))


# Patterns that are masked for comparing passages, in this order, with what stands for them.
# The first one is tried once for each stretch of its characters, from the stretch's first letter, so it takes linear time.
MASKS = (
    (r"(?:\G|(?<![a-z0-9 .,&'/-]))([0-9 .,&'/-]*+)[a-z][a-z0-9 .,&'/-]*+\|\s*q[1-4][^|\n]*form\s+10-[kq]\s*\|\s*\d+", "$1 "),
    (r"table \|", " table "),
    (r"\b(first|second|third|fourth|three|six|nine|twelve)\s+(quarter|months?)\b", " "),
    (r"\bq[1-4]\b", " "),
    (r"\b20\d{2}\b", " <year> "),
    (r"\b\d[\d,.\-$()%]*\b", " <num> "),
    (r"\s+", " "),
)


def selector_key(text: Column, limit: int = 1200) -> Column:
    """Lower case without page stamps and spans of quarters, years and numbers masked; for comparing passages.

    Only `limit` characters are kept, so of a long text its first sentences are masked, and the
    whole text only where they give too few. No mask reaches over the white space after such a
    sentence, which ends a line where the text has bars; without bars the first two masks can't match.
    """
    raw = F.coalesce(text, F.lit(""))

    def masked(t: Column, masks: tuple) -> Column:
        for pattern, new in masks:
            t = F.regexp_replace(t, pattern, new)
        return F.trim(t)

    def key(masks: tuple, gap: str) -> Column:
        whole = F.left(masked(F.lower(raw), masks), F.lit(limit))
        head = F.regexp_extract(F.lower(F.left(raw, F.lit(2 * limit))), rf"(?s)^(.*\.){gap}[a-z]", 1)
        first = F.transform(F.array(masked(head, masks)), lambda t: F.when(F.length(t) >= limit, F.left(t, F.lit(limit))))
        return F.when(F.length(raw) > 2 * limit, F.coalesce(first[0], whole)).otherwise(whole)

    return F.when(raw.contains("|"), key(MASKS, r"\n")).otherwise(key(MASKS[2:], r"\s"))


def count_hints(text: Column, hints: tuple[str, ...]) -> Column:
    """How many of the hints occur: ASCII ones as whole words, others anywhere."""
    low = F.lower(text)
    guard = lambda h: rf"(?<![a-z0-9])\Q{h}\E(?![a-z0-9])"
    return sum((F.coalesce((low.rlike(guard(h)) if h.isascii() else text.contains(h)).cast("int"), F.lit(0)) for h in hints), F.lit(0))


# Years and what makes them part of a standard's name; how questions name forms.
QUESTION_YEAR = r"(?<!\d)(20\d{2})(?!\d)"
YEAR_NOISE = r"\b(?:ASU|ASC|SAB|S-K|S-X|Topic|Item|Rule|No\.?|Note)\s*\.?\s*-?\s*(?:20\d{2})"
QUESTION_FORMS = (
    ("10-K", r"\b10-?Ks?\b|\bannual\s+reports?\b|年报|年度报告"),
    ("10-Q", r"\b10-?Qs?\b|\bquarterly\s+reports?\b|季报|季度报告"),
)


def question_years(question: Column) -> Column:
    """Years 20xx in order, each once, but those that belong to the name of a standard or rule."""
    bare = F.regexp_replace(question, f"(?iU){YEAR_NOISE}", "~")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?U){QUESTION_YEAR}"), F.lit(1)))


def question_forms(question: Column) -> Column:
    return F.array_compact(F.array(*[F.when(question.rlike(f"(?iU){pattern}"), F.lit(form)) for form, pattern in QUESTION_FORMS]))


def is_advert(text: Column) -> Column:
    """A telephone number, or two of the phrases of advertisements."""
    strong = sum((F.lower(text).contains(p).cast("int") for p in ADVERTISES), F.lit(0))
    return F.coalesce(text.rlike(r"\b1\d{10}\b|\b\d{3,4}-\d{7,9}\b") | (strong >= 2), F.lit(False))


def source_quality(title: Column, snippet: Column, place: Column, domains: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    """Known domains 0.8, terms 0.2 each up to 1.2, length up to 0.6, advertisements -1.5; nulls are empty."""
    title, snippet, place = (F.coalesce(c, F.lit("")) for c in (title, snippet, place))
    text = F.concat_ws("\n", title, snippet)
    hits = sum((F.lower(text).contains(t.lower()).cast("int") for t in terms), F.lit(0))
    score = F.when(holds(place, domains), 0.8).otherwise(0.0) + F.least(F.lit(1.2), hits * 0.2) + F.least(F.lit(0.6), F.length(F.trim(snippet)) / 300)
    return F.round(score - F.when(is_advert(text), 1.5).otherwise(0.0), 4)
