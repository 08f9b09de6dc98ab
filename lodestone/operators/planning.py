"""Question texts turned into plans, all columns of one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import narrative
from lodestone.functions import text as T

# Phrases and the metrics they name, in the order that breaks ties between phrases of one length.
ALIASES = (
    ("cost of revenue", ("CostOfRevenue", "CostOfGoodsAndServicesSold")),
    ("gross profit", ("GrossProfit",)),
    ("operating income", ("OperatingIncomeLoss",)),
    ("accounts payable", ("AccountsPayableCurrent", "AccountsPayable")),
    ("cash and cash equivalents", ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "Cash")),
    ("net income", ("NetIncomeLoss", "NetIncomeLossAttributableToParent", "NetIncome")),
    ("净利润", ("NetIncomeLoss", "NetIncomeLossAttributableToParent", "NetIncome")),
    ("净亏损", ("NetIncomeLoss",)),
    ("net loss", ("NetIncomeLoss",)),
    ("revenue", ("Revenues", "Revenue", "SalesRevenueNet", "OperatingRevenues")),
    ("sales", ("SalesRevenueNet", "Revenues")),
    ("eps", ("EarningsPerShareBasic", "EarningsPerShareDiluted")),
    ("ebitda", ("EarningsBeforeInterestTaxesDepreciationAmortization",)),
    ("interest income", ("InvestmentIncomeInterest", "InterestIncomeExpenseNet")),
    ("entity public float", ("EntityPublicFloat",)),
    ("public float", ("EntityPublicFloat",)),
)
# Forms and how they are written, amended ones first.
FORMS = (
    ("10-Q/A", r"10\s*[-.]?\s*Q\s*/\s*A\b"),
    ("10-K/A", r"10\s*[-.]?\s*K\s*/\s*A\b"),
    ("8-K/A", r"8\s*[-.]?\s*K\s*/\s*A\b"),
    ("10-Q", r"10\s*[-.]?\s*Q\b"),
    ("10-K", r"10\s*[-.]?\s*K\b"),
    ("8-K", r"8\s*[-.]?\s*K\b"),
)
# Words that ask for annual or quarterly reports where no form is written out.
ANNUAL = ("annual", "full year", "fiscal year", "year-end", "year end", "fy", "全年", "年度", "年报")
QUARTERLY = ("quarterly", "quarter", "qoq", "季度", "季报")
# Narrative targets and words that ask for them.
TARGETS = (
    ("management_discussion", ("md&a", "management discussion", "management's discussion", "management discussion and analysis", "operating results", "results of operation", "results of operations", "讨论与分析", "管理层讨论")),
    ("margin_cost_structure", ("cost structure", "cost of revenue", "gross margin", "operating margin", "成本结构", "毛利率", "营业利润率", "营业成本")),
    ("liquidity", ("liquidity", "capital resources", "working capital", "cash runway", "流动性", "资本资源", "营运资金")),
    ("going_concern", ("going concern", "substantial doubt", "持续经营")),
    ("risk_factors", ("risk factors", "风险因素")),
)
# What the query of the narrative leg adds for a target.
NARRATIVE_HINTS = {
    "risk_factors": "Item 1A Risk Factors; concentration of revenue; customer dependence; major customers; single-customer risk",
    "management_discussion": "Item 7 MD&A; management discussion and analysis; results of operations",
    "margin_cost_structure": "gross margin; cost of revenue; operating expenses; cost structure",
    "liquidity": "liquidity and capital resources; working capital; cash requirements",
    "going_concern": "going concern; substantial doubt about ability to continue",
}
# Words that compare filings.
COMPARES = ("compare", "versus", "vs", "变化", "对比", "trend", "evolution")
# Rows of facts, summaries, leaves, leaves of one filing and filings of a second pass, by question mode.
BUDGET_FIELDS = ("sql_rows", "summaries", "leaves", "per_filing", "second_pass")
BUDGETS = {
    "facts_only": (80, 6, 10, 3, 2),
    "narrative_only": (32, 12, 30, 8, 3),
    "cross_filing_compare": (96, 12, 30, 8, 4),
    "mixed_narrative_first": (56, 10, 24, 6, 3),
    "mixed_facts_first": (56, 10, 24, 6, 3),
}
# Sections a question names; they inform and filter nothing.
SCOPE_SECTIONS = (
    ("management_discussion", ("md&a", "management discussion", "管理层讨论")),
    ("risk_factors", ("risk factor", "风险因素")),
    ("liquidity", ("liquidity", "capital resources", "流动性")),
    ("business_overview", ("business overview", "业务概览")),
)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return T.holds_any(text, words)


def _named(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(text, words), F.lit(name)) for name, words in rules]))


def metrics_asked(question: Column, limit: int = 16) -> Column:
    """CamelCase names, then metrics of the phrases that occur, longest phrase first; each once."""
    low = F.lower(question)
    rules = sorted(ALIASES, key=lambda rule: -len(rule[0]))
    phrased = F.flatten(F.array(*[F.when(low.contains(phrase), _texts(tags)).otherwise(_texts(())) for phrase, tags in rules]))
    return F.slice(F.array_distinct(F.concat(T.metric_hints(question), phrased)), 1, limit)


def listed_metrics(keys: Column, limit: int = 16) -> Column:
    """Names without their namespace that the table of phrases knows, each once; for plans that a model wrote."""
    bare = F.transform(keys, lambda k: F.trim(F.element_at(F.split(F.trim(k), r"\."), -1)))
    known = sorted({tag for _, tags in ALIASES for tag in tags})
    return F.slice(F.array_distinct(F.filter(bare, lambda k: k.isin(*known))), 1, max(1, limit))


def forms_asked(question: Column) -> Column:
    """Forms written out; else 10-K or 10-Q where the words ask for one kind alone; else none."""
    low = F.lower(question)
    written = F.array_compact(F.array(*[F.when(question.rlike(f"(?iU){pattern}"), F.lit(form)) for form, pattern in FORMS]))
    annual = any_of(low, ANNUAL) | low.rlike(r"(?U)\bfy\s*20[0-9]{2}\b")
    quarterly = any_of(low, QUARTERLY) | low.rlike(r"(?U)\bq[1-3]\b") | low.contains("环比")
    inferred = F.when(annual & ~quarterly, _texts(("10-K",))).when(quarterly & ~annual, _texts(("10-Q",))).otherwise(_texts(()))
    return F.when(F.size(written) > 0, written).otherwise(inferred)


def plan(questions: DataFrame, question: str = "question", kind: str | None = None) -> DataFrame:
    """questions with what they ask for: metrics, forms, period_dates, period_years, compare_mode, prefer_recent,
    targets, mode, budget, needs, terms, retrieval_query and narrative_query.

    `kind` names a column that says numeric or narrative where that is known. A null question counts as
    empty; what a question doesn't ask for is an empty array or text. Columns of these names are replaced.
    """
    q = F.coalesce(F.col(question), F.lit(""))
    low = F.lower(q)
    base = F.trim(F.regexp_replace(q, r"^\s+|\s+$", ""))
    found = {
        "metrics": metrics_asked(q), "forms": forms_asked(q), "period_dates": T.period_dates(q), "period_years": T.period_years(q),
        "compare_mode": T.compare_mode(q), "prefer_recent": T.prefers_recent(q), "targets": _named(low, TARGETS),
    }
    planned = questions.withColumns(found)
    facts, told = F.size("metrics") > 0, F.size("targets") > 0
    asked = F.col(kind) if kind else F.lit(None).cast("string")
    mode = (
        F.when((F.size("period_years") >= 2) | any_of(low, COMPARES), "cross_filing_compare")
        .when(asked == "numeric", "facts_only")
        .when(asked == "narrative", "narrative_only")
        .when(told, "mixed_narrative_first")
        .when(facts | (F.size("period_dates") > 0), "mixed_facts_first")
        .otherwise("facts_only")
    )
    planned = planned.withColumn("mode", mode)
    budgets = F.create_map(*[x for m, b in BUDGETS.items() for x in (F.lit(m), F.struct(*[F.lit(v).alias(n) for n, v in zip(BUDGET_FIELDS, b, strict=True)]))])
    aliases = F.create_map(*[x for name, words in TARGETS for x in (F.lit(name), _texts(words[:3]))])
    hints = F.create_map(*[x for name, text in NARRATIVE_HINTS.items() for x in (F.lit(name), F.lit(text))])
    terms = F.concat(F.flatten(F.transform("targets", lambda t: F.element_at(aliases, t))), F.slice("metrics", 1, 6), F.col("forms"), F.slice("period_years", 1, 4), F.slice("period_dates", 1, 4))
    focus = F.slice(F.transform("targets", lambda t: F.element_at(hints, t)), 1, 4)
    narrative = F.col("mode") != "facts_only"
    return planned.withColumns({
        "budget": F.element_at(budgets, F.col("mode")),
        "needs": F.struct(narrative.alias("narrative"), (F.col("mode") != "narrative_only").alias("numeric"), (F.col("mode") == "cross_filing_compare").alias("cross_filing")),
        "terms": F.slice(F.array_distinct(terms), 1, 16),
        "retrieval_query": F.when((base == "") | ~facts, base).otherwise(F.concat(base, F.lit("\n\nXBRL metrics: "), F.array_join(F.slice("metrics", 1, 12), " "))),
        "narrative_query": F.when(~narrative | (base == ""), "").when(~told, base).otherwise(F.concat(base, F.lit("\n\nNarrative focus: "), F.array_join(focus, "; "))),
    })


def scope(question: Column) -> Column:
    """periods, forms, sections and whether one of the first two is explicit; null counts as empty."""
    q = F.coalesce(question, F.lit(""))
    periods, forms = narrative.question_years(q), narrative.question_forms(q)
    explicit = (F.size(periods) > 0) | (F.size(forms) > 0)
    return F.struct(periods.alias("periods"), forms.alias("forms"), _named(F.lower(q), SCOPE_SECTIONS).alias("sections"), explicit.alias("explicit"))


def narrowed(documents: DataFrame, scopes: DataFrame, key: str = "query_id") -> DataFrame:
    """(query_id, document_id): documents that have one of a scope's periods and one of its forms, as far as it names any.

    documents(document_id, years, forms); scopes(query_id, periods, forms), ids unique in both. A scope that
    names nothing, or that no document meets, has one row with a null document_id: the search isn't
    narrowed. Its pairs with all documents are never written out. Documents and scopes meet on values,
    and each kind of value is made distinct before kinds are counted. Null arrays hold nothing.
    """
    kinds = (("periods", "years"), ("forms", "forms"))

    def valued(kind: str, column: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(column, _texts(()))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    wanted = scopes.select(key, F.explode(F.concat(*[valued(k, k) for k, _ in kinds])).alias("x")).select(key, "x.*")
    has = documents.select("document_id", F.explode(F.concat(*[valued(k, c) for k, c in kinds])).alias("x")).select("document_id", "x.*")
    asked = scopes.select(key, sum((F.coalesce(F.size(F.col(c)) > 0, F.lit(False)).cast("int") for c, _ in kinds), F.lit(0)).alias("asked"))
    met = has.join(wanted, ["kind", "value"]).groupBy(key, "document_id").agg((F.max((F.col("kind") == "periods").cast("int")) + F.max((F.col("kind") == "forms").cast("int"))).alias("met"))
    hit = met.join(asked, key).filter("met = asked").select(key, "document_id")
    return asked.select(key).join(hit, key, "left")


# What each narrative target looks for, in titles and as soft hints.
TITLE_HINTS = {
    "liquidity": ("liquidity", "capital resource"),
    "results_of_operations": ("results of operations",),
    "management_discussion": ("management's discussion", "management discussion"),
    "risk_factors": ("risk factor",),
    "segment": ("segment",),
    "revenue": ("revenue", "net sales"),
    "operating": ("operating income", "operating expense"),
}
SOFT_HINTS = {
    "liquidity": {"section_role": ("liquidity",), "leaf_role": ("liquidity_driver",), "topic_tags": ("liquidity",), "rerank_terms": ("liquidity", "capital resources", "working capital")},
    "margin_cost_structure": {"section_role": ("results_of_operations",), "leaf_role": ("results_driver",), "topic_tags": ("gross_margin", "cost_of_revenue", "operating_expense"), "rerank_terms": ("gross margin", "cost of revenue", "operating expenses")},
    "going_concern": {"section_role": ("liquidity",), "leaf_role": ("liquidity_driver",), "topic_tags": ("liquidity",), "rerank_terms": ("going concern", "substantial doubt")},
    "management_discussion": {"section_role": ("mda", "results_of_operations"), "leaf_role": ("results_driver",), "topic_tags": ("revenue", "operating_income"), "rerank_terms": ("management discussion and analysis", "results of operations")},
    "risk_factors": {"section_role": ("risk_factors",), "leaf_role": ("risk_factor_item",), "topic_tags": (), "rerank_terms": ("risk factors",)},
}
FOCUS = {
    "risk_factors": ("distribution through carriers, wholesalers, retailers, resellers, channel dependence.", "trade receivables, counterparties, credit risk, supplier or customer payment exposure."),
    "results": ("gross margin, operating expenses, cost of revenue and results of operations drivers.",),
}
COMPLIANCE = ("问询", "回复", "合规", "draft", "comment letter", "监管", "草稿")


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def titled_for(title: Column, targets: Column) -> Column:
    """Whether a title holds a keyword of a target; a target without keywords is its own, _ read as a space."""
    low = F.lower(F.coalesce(title, F.lit("")))
    known = F.create_map(*[x for t, words in TITLE_HINTS.items() for x in (F.lit(t), _texts(words))])
    words = F.flatten(F.transform(targets, lambda t: F.coalesce(F.try_element_at(known, t), F.array(F.replace(t, F.lit("_"), F.lit(" "))))))
    return F.coalesce(F.exists(words, lambda w: low.contains(F.lower(w))), F.lit(False))


def soft_hints(targets: Column) -> Column:
    """section_role, leaf_role, topic_tags and rerank_terms of all targets, in their order, each once."""

    def of(field: str) -> Column:
        known = F.create_map(*[x for t, hints in SOFT_HINTS.items() for x in (F.lit(t), _texts(hints[field]))])
        return F.array_distinct(F.flatten(F.transform(targets, lambda t: F.coalesce(F.try_element_at(known, F.trim(t)), _texts(())))))

    return F.struct(*[of(f).alias(f) for f in ("section_role", "leaf_role", "topic_tags", "rerank_terms")])


def rerank_queries(query: Column, targets: Column, most: int = 3) -> Column:
    """The query, and with it what its targets ask to focus on; at most six, and `most`."""
    base = F.trim(F.coalesce(query, F.lit("")))
    focused = lambda key: F.transform(_texts(("", *FOCUS[key])), lambda f: F.when(f == "", base).otherwise(F.concat(base, F.lit("\nFocus: "), f)))
    results = F.array_contains(targets, "margin_cost_structure") | F.array_contains(targets, "management_discussion")
    found = F.when((base != "") & F.array_contains(targets, "risk_factors"), focused("risk_factors")).when((base != "") & results, focused("results")).otherwise(F.array(base))
    return F.slice(F.array_distinct(found), 1, max(1, min(most, 6)))


def section_policy(targets: Column) -> Column:
    """Stricter for questions about management's discussion, margins and liquidity."""
    strict = F.coalesce(F.exists(targets, lambda t: F.lower(F.trim(t)).isin("management_discussion", "margin_cost_structure", "liquidity")), F.lit(False))
    return F.struct(strict.alias("penalize_forward_looking"), strict.alias("penalize_early_position"), F.when(strict, 2.0).otherwise(1.5).alias("pass_score"))


def scenario(question: Column) -> Column:
    return F.when(any_of(F.lower(F.coalesce(question, F.lit(""))), COMPLIANCE), "compliance").otherwise("research")


def risk_flags(n_citations: Column, n_facts: Column, limitations: Column, reasons: Column) -> Column:
    """What an answer lacks, in order."""
    return F.array_compact(
        F.array(
            F.when(n_citations == 0, "no_citations"), F.when(n_facts == 0, "no_sql"), F.when(F.coalesce(limitations, F.lit("")) != "", "limitations"),
            F.when(F.array_contains(reasons, "filing_divergence"), "filing_divergence"),
        )
    )
