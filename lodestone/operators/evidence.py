"""Evidence put together: facts and filings ranked for a plan, filings weighed over both kinds of evidence, passages and facts aligned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import formats
from lodestone.functions import text as T


#: Rows that a task of priority_union reads, and the buckets that a query's nodes are dealt into.
ROWS_A_TASK = 500_000
NODE_BUCKETS = 16


def no_texts() -> Column:
    return F.array().cast("array<string>")


def ranked_facts(rows: DataFrame, accessions: Column, metrics: Column, terms: Column, by: list[str]) -> DataFrame:
    """rows(*by, id, accn, taxonomy, metric_key, metric_label, form, frame, value_numeric, value_text, period_end, filed_date, position) by use for a plan.

    4 for a wanted filing, 5 for a wanted metric, 2 for a term, 0.5 for a number. Where any row
    of a group scores, those that don't go. Ties go to later periods, filings and ids, then to
    the row that came first. Null arrays want nothing.
    """
    blob = F.lower(F.concat_ws(" ", "metric_key", "metric_label", "taxonomy", "form", "frame", "value_text"))
    local = F.element_at(F.split("metric_key", r"\."), -1)
    wants = lambda values, test: F.coalesce(F.exists(values, test), F.lit(False))
    parts = (
        (wants(accessions, lambda a: a == F.trim("accn")), 4.0),
        (wants(metrics, lambda m: F.element_at(F.split(m, r"\."), -1) == local), 5.0),
        (wants(terms, lambda t: (t != "") & blob.contains(F.lower(t))), 2.0),
        (F.col("value_numeric").isNotNull(), 0.5),
    )
    scored = rows.withColumn("score", sum((F.when(met, w).otherwise(0.0) for met, w in parts), F.lit(0.0)))
    best = F.max("score").over(W.partitionBy(*by))
    kept = scored.withColumn("__best", best).filter((F.col("score") > 0) | (F.col("__best") <= 0)).drop("__best")
    order = [F.desc("score"), F.desc_nulls_last("period_end"), F.desc_nulls_last("filed_date"), F.desc_nulls_last("id"), "position"]
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def filing_years(catalog: DataFrame) -> DataFrame:
    """catalog(accession, form, filed, period_end_dates, period_years) with form_base and candidate_years, at most six.

    Years told, then that of the accession, of period ends and of filing; of annual and quarterly
    reports filed until April also the year before.
    """
    base = F.nullif(T.form_base(F.col("form")), F.lit(""))
    year = lambda d: F.left(d, F.lit(4)).try_cast("int")
    filed = year(F.col("filed"))
    early = F.when((F.substring("filed", 6, 2).try_cast("int") <= 4) & base.isin("10-K", "10-Q"), filed - 1)
    dated = F.slice(F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce("period_end_dates", no_texts()), year), F.array(filed, early)))), 1, 4)
    told = F.coalesce(F.col("period_years"), F.array().cast("array<int>"))
    own = F.when(F.col("accession").rlike(r"^[^-]*-\d{2}-[^-]*$"), T.accession_year(F.col("accession")))
    years = F.array_distinct(F.array_compact(F.concat(told, F.array(own), dated)))
    return catalog.withColumn("form_base", base).withColumn("candidate_years", F.slice(years, 1, 6))


def filing_hypotheses(catalog: DataFrame, plans: DataFrame, scope: DataFrame, limit: int = 6) -> DataFrame:
    """(query_id, accession, weight, rank): the filings that most likely answer each plan.

    plans(query_id, forms, years, dates, compare_mode, prefer_recent); scope(query_id,
    document_id) says which documents a query may use, so plans and filings meet by key only.
    How many are kept follows the way of comparing.
    """
    pairs = filing_years(catalog).join(scope, "document_id").join(plans, "query_id")
    newest = W.partitionBy("query_id").orderBy(F.coalesce("filed", F.lit("")).desc(), F.coalesce(F.element_at("period_end_dates", -1), F.lit("")).desc(), F.desc("accession"))
    of_query = W.partitionBy("query_id")
    bonus = 0.18 * (1 - (F.row_number().over(newest) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(of_query) - 1))
    pairs = pairs.withColumn("bonus", bonus).withColumn("bonus", F.min("bonus").over(W.partitionBy("query_id", "accession")))

    def agreed(asked: Column, met: Column, known: Column, gains: float, loses: float, lacks: float) -> Column:
        return F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, 0.0).when(F.coalesce(met, F.lit(False)), gains).when(F.coalesce(known, F.lit(False)), -loses).otherwise(-lacks)

    forms, mode, recent = F.transform(F.coalesce("forms", no_texts()), T.form_base), F.coalesce("compare_mode", F.lit("generic")), F.coalesce("prefer_recent", F.lit(False))
    compared = (
        F.when((mode == "qoq") & (F.col("form_base") == "10-Q"), 0.12)
        .when((mode == "qoq") & (F.col("form_base") == "10-K"), -0.06)
        .when((mode == "yoy") & F.col("form_base").isin("10-K", "10-Q"), 0.08)
        .when(mode == "latest", 0.04)
        .otherwise(0.0)
    )
    score = (
        0.02
        + agreed(F.col("forms"), F.array_contains(forms, F.col("form_base")), F.col("form_base").isNotNull(), 0.34, 0.26, 0.08)
        + agreed(F.col("dates"), F.arrays_overlap("dates", "period_end_dates"), F.size("period_end_dates") > 0, 0.34, 0.28, 0.08)
        + agreed(F.col("years"), F.arrays_overlap("years", "candidate_years"), F.size("candidate_years") > 0, 0.22, 0.18, 0.06)
        + compared
        + F.when(recent, F.col("bonus")).otherwise(F.least("bonus", F.lit(0.08)))
    )
    asks_nothing = reduce(Column.__and__, [F.coalesce(F.size(c), F.lit(0)) <= 0 for c in ("forms", "dates", "years")]) & (mode == "generic") & ~recent
    weight = F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.when(asks_nothing, F.least(score, F.lit(0.18))).otherwise(score))), 4)
    keep = F.when(mode.isin("yoy", "qoq"), F.greatest(F.lit(2), F.lit(min(limit, 4)))).when(recent, F.greatest(F.lit(1), F.lit(min(limit, 2)))).otherwise(F.greatest(F.lit(2), F.lit(min(limit, 3))))
    once = pairs.select("query_id", "accession", "filed", weight.alias("weight"), keep.alias("keep")).groupBy("query_id", "accession").agg(F.max(F.struct("weight", "filed", "keep")).alias("b"))
    order = W.partitionBy("query_id").orderBy(F.desc("b.weight"), F.desc_nulls_last("b.filed"), F.desc("accession"))
    return once.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= F.col("b.keep")).select("query_id", "accession", F.col("b.weight").alias("weight"), "rank")


def filing_key(accessions: Column, document_id: Column) -> Column:
    """The first accession of a row, else `document:` with its id."""
    return F.coalesce(F.get(F.filter(accessions, lambda a: F.trim(a) != ""), 0), F.concat(F.lit("document:"), document_id.cast("string")))


def hit_weights(hits: DataFrame) -> DataFrame:
    """hits(query_id, accessions, score, rank) -> weight of each accession: scores, less by rank, at least 0.01 each."""
    each = F.greatest(F.lit(0.01), F.coalesce("score", F.lit(0.0)) / (1 + 0.05 * (F.col("rank") - 1)))
    return hits.select("query_id", F.explode("accessions").alias("filing"), each.alias("w")).groupBy("query_id", "filing").agg(F.sum("w").alias("weight"))


def merged_weights(parts: list[DataFrame]) -> DataFrame:
    """Sums over distributions(query_id, filing, weight); filings that are only a document's id are left out."""
    rows = reduce(DataFrame.unionByName, [p.select("query_id", "filing", "weight") for p in parts])
    return rows.filter("filing is not null and filing not like 'document:%'").groupBy("query_id", "filing").agg(F.round(F.sum("weight"), 4).alias("weight"))


def target_filings(facts: DataFrame, passages: DataFrame, plans: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, filing, primary, rank): the weightiest filings of the leading kind of evidence, then of the other one.

    Passages lead where plans(query_id, mode) asks for narrative; of each kind at most `limit` count, and of both.
    """
    leads = plans.select("query_id", F.col("mode").isin("narrative_only", "mixed_narrative_first").alias("narrative"))
    tagged = facts.withColumn("passage", F.lit(False)).unionByName(passages.withColumn("passage", F.lit(True)))
    tagged = tagged.filter("filing is not null and filing not like 'document:%'").join(leads, "query_id")
    place = W.partitionBy("query_id", "passage").orderBy(F.desc("weight"), "filing")
    top = tagged.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).withColumn("second", F.col("passage") != F.col("narrative"))
    once = top.groupBy("query_id", "filing").agg(F.min(F.struct("second", "place")).alias("at"))
    order = W.partitionBy("query_id").orderBy("at")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).select("query_id", "filing", (~F.col("at.second")).alias("primary"), "rank")


def second_pass(plans: DataFrame, facts: DataFrame, passages: DataFrame) -> DataFrame:
    """plans(query_id, need_narrative, need_facts) with has_narrative, has_facts, the dominant filings, and the reasons to search again."""
    top = lambda rows, name: rows.groupBy("query_id").agg(F.max_by("filing", F.struct("weight", F.expr("-xxhash64(filing)"))).alias(name))
    joined = plans.join(top(facts, "facts_filing"), "query_id", "left").join(top(passages, "passage_filing"), "query_id", "left")
    joined = joined.withColumn("has_facts", F.col("facts_filing").isNotNull()).withColumn("has_narrative", F.col("passage_filing").isNotNull())
    reasons = F.array_compact(
        F.array(
            F.when(F.col("need_narrative") & ~F.col("has_narrative"), "missing_narrative"),
            F.when(F.col("need_facts") & ~F.col("has_facts"), "missing_structured"),
            F.when(F.col("facts_filing") != F.col("passage_filing"), "filing_divergence"),
        )
    )
    return joined.withColumn("reasons", F.when(F.col("has_facts") | F.col("has_narrative"), reasons).otherwise(no_texts()))


def aligned_context(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, context): passages and facts by filing, for queries of which some filing has both.

    facts(query_id, accn, form, rank and the columns of formats.fact_lines), passages(query_id,
    accn, rank, text). Filings come as they first appear, facts before passages; rows without a
    filing come last.
    """
    keyed = ["query_id", "accn"]
    heads = facts.groupBy(*keyed).agg(F.min("rank").alias("at"), F.min_by("form", "rank").alias("form"), F.min_by(F.col("period_end").cast("string"), "rank").alias("period"))
    marked = facts.withColumn("accn", F.coalesce("accn", F.lit("")))
    lines = formats.fact_lines(marked, keyed, [F.col("rank")], 1 << 30)
    heads = heads.withColumn("accn", F.coalesce("accn", F.lit(""))).join(lines, keyed)
    told = passages.filter("trim(coalesce(text, '')) <> ''").withColumn("accn", F.coalesce("accn", F.lit("")))
    numbered = told.withColumn("n", F.row_number().over(W.partitionBy(*keyed).orderBy("rank")))
    line = F.concat(F.lit("  Passage "), F.col("n").cast("string"), F.lit(": "), F.trim("text"))
    texts = numbered.withColumn("line", line).groupBy(*keyed).agg(F.min("rank").alias("seen"), F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("passages"))
    both = heads.join(texts, keyed, "full_outer")
    period = F.when(F.col("period").isNotNull(), F.concat(F.lit(", period ending "), "period")).otherwise("")
    title = F.concat(F.lit("== Filing "), "accn", F.when(F.coalesce("form", F.lit("")) != "", F.concat(F.lit(" ("), "form", period, F.lit(")"))).otherwise(""), F.lit(" =="))
    none = F.col("accn") == ""
    named = F.concat_ws("\n", title, F.when(F.col("passages").isNotNull(), F.concat(F.lit("[Narrative passages]\n"), "passages")), F.when(F.col("lines").isNotNull(), F.concat(F.lit("[Structured XBRL facts]\n"), "lines")))
    rest = F.concat_ws("\n\n", F.when(F.col("lines").isNotNull(), F.concat(F.lit("[Other structured facts]\n"), "lines")), F.when(F.col("passages").isNotNull(), F.concat(F.lit("[Other retrieved passages]\n"), "passages")))
    part = F.struct(none.alias("last"), F.col("at").isNull().alias("later"), F.coalesce("at", "seen").alias("place"), F.when(none, rest).otherwise(named).alias("text"))
    paired = F.max(~none & F.col("lines").isNotNull() & F.col("passages").isNotNull())
    grouped = both.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), paired.alias("paired"))
    return grouped.filter("paired").select("query_id", F.array_join("parts.text", "\n\n").alias("context"))


def merged_subqueries(hits: DataFrame, keep: int) -> DataFrame:
    """hits(query_id, sub, node_id, score): of each sub-query its share of the best, of each node the best score, the best `keep`.

    A sub-query's share is keep / their number, but at least min(12, keep).
    """
    subs = hits.groupBy("query_id").agg(F.count_distinct("sub").alias("subs"))
    share = F.greatest(F.floor(F.lit(keep) / F.col("subs")), F.lit(min(12, keep)))
    place = F.row_number().over(W.partitionBy("query_id", "sub").orderBy(F.desc_nulls_last("score"), "node_id"))
    best = hits.withColumn("place", place).join(subs, "query_id").filter((F.col("place") <= share) | (F.col("subs") == 1)).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "node_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep)


def priority_union(lists: list[DataFrame], limit: int) -> DataFrame:
    """lists of (query_id, node_id, rank), the first ones first, each node once, at most `limit`.

    Rows are dealt by query and a bucket of nodes to one task for every ROWS_A_TASK, so a task's
    share doesn't grow with the lists; of a query only `limit` rows leave each bucket.
    """
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "node_id", "rank").withColumn("list", F.lit(i)) for i, x in enumerate(lists)])
    tasks = max(1, -(-rows.count() // ROWS_A_TASK))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(NODE_BUCKETS))).repartition(tasks, "query_id", "bucket")
    once = dealt.groupBy("query_id", "bucket", "node_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    order = ["at", "node_id"]
    few = once.withColumn("place", F.row_number().over(W.partitionBy("query_id", "bucket").orderBy(*order))).filter(F.col("place") <= limit).select("query_id", "node_id", "at")
    last = F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long")
    return few.repartition(tasks, "query_id").withColumn("rank", last).filter(F.col("rank") <= limit).select("query_id", "node_id", "rank")


def overlaid(hits: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """hits with the scores of the same query and node put over theirs where not null."""
    fresh = scores.select("query_id", "node_id", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = hits.join(fresh, ["query_id", "node_id"], "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in hits.columns])


def touches(accessions: Column, tags: Column, blob: Column, wanted_accessions: Column, wanted_tags: Column) -> Column:
    """Whether a passage bears on facts: arrays overlap, or its text holds an accession or tag."""
    said = lambda wanted: F.exists(wanted, lambda w: (w != "") & F.lower(blob).contains(F.lower(w)))
    tests = (F.arrays_overlap(accessions, wanted_accessions), F.arrays_overlap(tags, wanted_tags), said(wanted_accessions), said(wanted_tags))
    return reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests])


def match_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s，。、“”‘’？！!?,.:;；（）()【】\[\]<>《》\-_/\\|]+", "")


def best_sources(leads: DataFrame, sources: DataFrame, least: float = 0.05, limit: int = 3) -> DataFrame:
    """(query_id, lead_id, url, score, rank): the sources that best match each lead by trigrams plus 0.05 of their quality.

    leads(query_id, lead_id, text), sources(query_id, url, text, quality). A text that contains
    the other matches whole. Pairs come from shared trigrams; texts of under three characters have
    none and match nothing.
    """
    grams = lambda rows, key: rows.select("query_id", key, F.explode(T.trigrams(F.col("__text"))).alias("g"))
    a = leads.withColumn("__text", match_text(F.col("text")))
    b = sources.withColumn("__text", match_text(F.col("text"))).dropDuplicates(["query_id", "url"])
    shared = grams(a, "lead_id").join(grams(b, "url"), ["query_id", "g"]).groupBy("query_id", "lead_id", "url").agg(F.count(F.lit(1)).alias("n"))
    left = a.select("query_id", "lead_id", F.col("__text").alias("x"))
    right = b.select("query_id", "url", F.col("__text").alias("y"), "quality")
    pairs = shared.join(left, ["query_id", "lead_id"]).join(right, ["query_id", "url"])
    either = F.size(T.trigrams(F.col("x"))) + F.size(T.trigrams(F.col("y"))) - F.col("n")
    alike = F.when(F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")), 1.0).otherwise(F.col("n") / either)
    scored = pairs.withColumn("score", F.round(alike + 0.05 * F.coalesce("quality", F.lit(0.0)), 6)).filter(F.col("score") >= least)
    order = W.partitionBy("query_id", "lead_id").orderBy(F.desc("score"), "url")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).select("query_id", "lead_id", "url", "score", "rank")


def packed_context(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """(query_id, context, parts): numbered hits(query_id, rank, filename, page_no, title, kind, text) until the first that would pass the budget.

    Pictures count by their description. A query whose first hit is too long has an empty context.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    by = W.partitionBy("query_id").orderBy("rank")
    label = F.concat(F.lit("["), F.row_number().over(by).cast("string"), F.lit("] "), blank("filename"), F.lit(" 第"), (F.coalesce("page_no", F.lit(0)) + 1).cast("string"), F.lit("页"))
    label = F.concat(label, F.when(blank("title") != "", F.concat(F.lit(" · "), "title")).otherwise(""))
    body = F.concat(F.when(F.col("kind") == "image", "（图片描述）").otherwise(""), blank("text"))
    parts = hits.withColumn("part", F.concat(label, F.lit("\n"), body))
    used = parts.withColumn("used", F.sum(F.length("part")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.when(F.col("used") <= budget, F.struct("rank", "part"))
    grouped = used.groupBy("query_id").agg(F.array_sort(F.collect_list(fits)).alias("kept"))
    return grouped.select("query_id", F.array_join("kept.part", "\n\n").alias("context"), F.size("kept").cast("long").alias("parts"))


def second_query(question: Column, filings: Column, leads: Column, targets: Column) -> Column:
    """A question with the likely filings (3), the leading kind of evidence and the narrative targets (4), a line each."""
    listed = lambda head, values, n: F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(F.slice(values, 1, n), ", ")))
    led = F.when(F.coalesce(leads, F.lit("")) != "", F.concat(F.lit("Coordination mode: "), leads, F.lit("-led")))
    more = F.concat_ws("\n", listed("Likely filings: ", filings, 3), led, listed("Narrative targets: ", targets, 4))
    base = F.trim(F.coalesce(question, F.lit("")))
    return F.when(more == "", base).otherwise(F.concat(base, F.lit("\n\n"), more))
