"""Queries over roles, citability, ranked facts and filings, draws and page elements; orders play filings, lineitem facts and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunking, formats, narrative
from lodestone.functions import text as T
from lodestone.operators import evaluation, evidence, planning, sampling
from lodestone.plans.questions import ASKED_SQL, asked_of_orders
from lodestone.session import table
from lodestone.sources import filings


def filing_hypotheses(spark, sf_dir):
    """For each nation the orders that best fit its plan: yearly comparison for odd keys, the newest for even ones."""
    accession = F.concat(F.lit("0000000001-"), F.date_format("o_orderdate", "yy"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    # Six digits don't tell orders beyond 999,999 apart, so the whole key follows while filings are ranked.
    whole = F.concat(accession, F.lit("."), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    catalog = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), whole.alias("accession"), F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").otherwise("10-Q").alias("form"), day("o_orderdate").alias("filed"),
        F.array(day(F.col("o_orderdate") - F.expr("interval 30 days"))).alias("period_end_dates"), F.array().cast("array<int>").alias("period_years"),
    )
    odd = F.col("n_nationkey") % 2 == 1
    plans = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.array(F.lit("10-K")).alias("forms"), F.array(F.lit(1995)).alias("years"), F.array().cast("array<string>").alias("dates"),
        F.when(odd, "yoy").otherwise("generic").alias("compare_mode"), (~odd).alias("prefer_recent"),
    )
    scope = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("document_id"))
    found = evidence.filing_hypotheses(catalog, plans, scope)
    return found.select("query_id", F.split("accession", r"\.")[0].alias("accession"), "weight", "rank")


def facts_for_plan(spark, sf_dir):
    """Lines of each supplier ranked for a plan that wants one filing, one metric and one term."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("o"), (F.col("l_orderkey") % 100).cast("string")).alias("accn"), F.lit("line").alias("taxonomy"),
        F.concat(F.lit("line."), "l_returnflag").alias("metric_key"), F.lit("").alias("metric_label"), F.col("l_linestatus").alias("form"), F.lit("").alias("frame"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value_numeric"),
        F.lit(None).cast("string").alias("value_text"), F.col("l_shipdate").alias("period_end"), F.lit(None).cast("string").alias("filed_date"), F.col("l_orderkey").alias("position"),
    )
    wants = lambda *v: F.array(*[F.lit(x) for x in v])
    return evidence.ranked_facts(rows, wants("o7", "o8"), wants("R"), wants("line.n"), ["l_suppkey"]).select("l_suppkey", "id", "score", "rank")


def subqueries_merged(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_linenumber").alias("sub"), F.col("l_partkey").alias("node_id"), F.col("l_quantity").alias("score"))
    return evidence.merged_subqueries(hits, 24)


def lists_by_priority(spark, sf_dir):
    """Of each supplier returned lines by price, then the others."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("rank"), "l_returnflag")
    return evidence.priority_union([hits.filter("l_returnflag = 'R'"), hits.filter("l_returnflag <> 'R'")], 40)


def weights_merged(spark, sf_dir):
    """Weights of suppliers by nation of the customer, from lines and from ranks within an order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hits = lines.select(F.col("c_nationkey").alias("query_id"), F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("accessions"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("rank"))
    facts = lines.groupBy(F.col("c_nationkey").alias("query_id"), F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("document:"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("filing"))
    return evidence.merged_weights([evidence.hit_weights(hits), facts.agg((F.count(F.lit(1)) * 0.5).cast("double").alias("weight"))])


def evaluation_draw(spark, sf_dir):
    """Groups of three documents, source and language in turn."""
    return sampling.drawn(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 60, 3)


def citability(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", narrative.citable(F.col("text"), T.causal_signals(F.coalesce("text", F.lit("")))).alias("c"))
    return found.select("doc_id", "c.score", "c.blocked", F.array_join("c.flags", ",").alias("flags"), F.col("c.sentences").cast("long").alias("sentences"))


def passage_roles(spark, sf_dir):
    """Role and topics of every document, its source as title and its language as path."""
    parts = (F.col("source"), F.array("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", narrative.section_role(*parts).alias("role"), F.array_join(narrative.topics(*parts), ",").alias("topics"))


def fact_values(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select("event_id", formats.fact_value(F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 4), none).alias("shown"), formats.score_value(F.col("value") / 100).alias("score"))


def page_elements(spark, sf_dir):
    """Narrative and tables of every page, with sections."""
    found = filings.element_rows(table(spark, sf_dir, "pages"), "page_id", refine=False)
    return found.select("page_id", "position", "element_id", "element_type", F.array_join("section_path", " / ").alias("section"), "table_name", "text")


def leak_check(spark, sf_dir):
    """Runs of 16 characters that benchmark items and documents have in common."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return evaluation.copied_runs(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def question_plan(spark, sf_dir):
    """The plan of a question made from every order."""
    planned = planning.plan(asked_of_orders(spark, sf_dir))
    texts = [F.array_join(c, ",").alias(c) for c in ("metrics", "forms", "period_dates", "period_years", "targets", "terms")]
    return planned.select("query_id", "mode", *texts, *[F.col(f"budget.{f}").cast("long").alias(f) for f in planning.BUDGET_FIELDS], "needs.narrative", "needs.numeric", "needs.cross_filing", "retrieval_query", "narrative_query")


def sentence_chunks(spark, sf_dir):
    """Pieces of every document for embedding."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.embedding_pieces(F.col("text"))).alias("place", "piece"))
    return found.select("doc_id", "place", F.length("piece").cast("long").alias("size"), F.md5("piece").alias("key"))


QUERIES = {f.__name__: f for f in (filing_hypotheses, facts_for_plan, subqueries_merged, lists_by_priority, weights_merged, evaluation_draw, citability, passage_roles, fact_values, page_elements, leak_check, question_plan, sentence_chunks)}


def _holds(text: str, phrases: tuple[str, ...]) -> str:
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in quoted) + ")"


ORACLES = {
    "filing_hypotheses": """WITH c AS (
        SELECT c_nationkey AS q, '0000000001-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession, o_orderpriority = '1-URGENT' AS annual, strftime(o_orderdate, '%Y-%m-%d') AS filed,
               strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') AS ended, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders JOIN customer ON c_custkey = o_custkey),
      b AS (SELECT *, 0.18::DOUBLE * (1 - (row_number() OVER (PARTITION BY q ORDER BY filed DESC, ended DESC, accession DESC) - 1) / greatest(1, count(*) OVER (PARTITION BY q) - 1)) AS bonus,
              1995 IN (y, CAST(left(ended, 4) AS INTEGER), CASE WHEN m <= 4 THEN y - 1 ELSE y END) AS met FROM c),
      s AS (SELECT q, accession, filed, round(greatest(0::DOUBLE, least(0.99::DOUBLE,
              0.02::DOUBLE + (CASE WHEN annual THEN 0.34::DOUBLE ELSE -0.26::DOUBLE END) + (CASE WHEN met THEN 0.22::DOUBLE ELSE -0.18::DOUBLE END)
              + (CASE WHEN q % 2 = 1 THEN 0.08::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN q % 2 = 0 THEN bonus ELSE least(bonus, 0.08::DOUBLE) END))), 4) AS weight FROM b),
      r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, filed DESC, accession DESC) AS rank FROM s)
      SELECT q AS query_id, accession, weight, rank FROM r WHERE rank <= CASE WHEN q % 2 = 1 THEN 4 ELSE 2 END""",
    "facts_for_plan": """WITH s AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, (CASE WHEN l_orderkey % 100 IN (7, 8) THEN 4 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END)
        + (CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END) + (CASE WHEN l_quantity > 10 THEN 0.5::DOUBLE ELSE 0 END) AS score FROM lineitem),
      k AS (SELECT *, max(score) OVER (PARTITION BY l_suppkey) AS best FROM s)
      SELECT l_suppkey, id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_shipdate DESC NULLS LAST, id DESC) AS rank FROM k WHERE score > 0 OR best <= 0""",
    "subqueries_merged": """WITH n AS (SELECT l_suppkey AS q, count(DISTINCT l_linenumber) AS subs FROM lineitem GROUP BY 1),
      p AS (SELECT l_suppkey AS q, l_partkey AS node_id, l_quantity AS score, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity DESC NULLS LAST, l_partkey) AS place FROM lineitem),
      b AS (SELECT q, node_id, max(score) AS score FROM p JOIN n USING (q) WHERE place <= greatest(24 // subs, 12) OR subs = 1 GROUP BY ALL)
      SELECT q AS query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC NULLS LAST, node_id) AS rank FROM b) WHERE rank <= 24""",
    "lists_by_priority": """WITH a AS (SELECT l_suppkey AS query_id, l_partkey AS node_id, min(struct_pack(list := CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, at := l_orderkey)) AS m FROM lineitem GROUP BY ALL)
      SELECT query_id, node_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, node_id) AS rank FROM a) WHERE rank <= 40""",
    "weights_merged": """WITH l AS (SELECT c_nationkey AS query_id, l_suppkey, l_discount, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
      w AS (SELECT query_id, l_suppkey, sum(greatest(0.01::DOUBLE, l_discount / (1 + 0.05::DOUBLE * (l_linenumber - 1)))) AS weight FROM l GROUP BY ALL
            UNION ALL SELECT query_id, l_suppkey, count(*) * 0.5::DOUBLE FROM l WHERE l_suppkey % 7 <> 0 GROUP BY ALL)
      SELECT query_id, 's' || l_suppkey AS filing, round(sum(weight), 4) AS weight FROM w GROUP BY query_id, l_suppkey""",
    "evaluation_draw": """WITH p AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('20260918:' || doc_id), doc_id) - 1 AS n, count(*) OVER (PARTITION BY source, lang) AS c FROM documents),
      w AS (SELECT *, n // 3 AS r FROM p WHERE (n // 3 + 1) * 3 <= c),
      g AS (SELECT source, lang, r, row_number() OVER (ORDER BY r, source NULLS FIRST, lang NULLS FIRST) - 1 AS "group" FROM w WHERE n % 3 = 0)
      SELECT w.doc_id, w.source, w.lang, "group", n % 3 + 1 AS place FROM w JOIN g ON w.r = g.r AND w.source IS NOT DISTINCT FROM g.source AND w.lang IS NOT DISTINCT FROM g.lang WHERE "group" < 60""",
    "citability": rf"""WITH b AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents),
      l AS (SELECT *, lower(t) AS low, length(t) AS n, list_filter(list_transform(regexp_split_to_array(t, '\r\n?|\n'), lambda x: trim(x)), lambda x: x <> '') AS lines, len(regexp_extract_all(t, '[.!?](\s|$)')) AS e FROM b),
      f AS (SELECT *, CASE WHEN e > 0 THEN e ELSE len(list_filter(lines, lambda x: length(x) >= 60)) END AS ends,
              coalesce(list_sum(list_transform(list_filter(lines, lambda x: starts_with(lower(x), 'table |')), lambda x: length(x))), 0) / greatest(n, 1) AS tables,
              coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT starts_with(lower(x), 'table |')), lambda x: length(x))), 0) / greatest(n, 1) AS told,
              n > 0 AND ({_holds("low", narrative.HEADINGS)} OR n <= 420) AS headed, {_holds("low", narrative.REFERS)} AS refers, {_holds("low", T.CAUSAL)} AS explains FROM l),
      k AS (SELECT *, contains(low, 'table of contents') AS toc, n < 120 AND ends < 2 AS short, headed AND ends = 0 AND len(lines) <= 4 AS bare, refers AND NOT explains AND ends <= 2 AS only_refers FROM f),
      s AS (SELECT *, toc OR short OR bare AS blocked FROM k)
      SELECT doc_id, CASE WHEN blocked THEN 0::DOUBLE ELSE round(((n >= 220)::INT * 0.8 + (ends >= 2)::INT * 0.8 + (told >= 0.6)::INT * 0.8 - (ends = 0)::INT * 1.0 - (tables >= 0.75)::INT * 0.8
               - only_refers::INT * 1.0 - (refers AND NOT only_refers)::INT * 0.4 - (headed AND n < 500)::INT * 0.4)::DOUBLE, 4) END AS score, blocked,
             concat_ws(',', CASE WHEN toc THEN 'toc' END, CASE WHEN short THEN 'too_short' END, CASE WHEN bare THEN 'heading_only' END, CASE WHEN NOT blocked AND ends = 0 THEN 'no_sentence' END, CASE WHEN NOT blocked AND tables >= 0.75 THEN 'table_heavy' END,
               CASE WHEN NOT blocked AND only_refers THEN 'cross_ref_only' END, CASE WHEN NOT blocked AND refers AND NOT only_refers THEN 'cross_ref' END, CASE WHEN NOT blocked AND headed AND n < 500 THEN 'heading_like' END) AS flags,
             ends AS sentences FROM s""",
    "passage_roles": rf"""WITH s AS (SELECT doc_id, lang, source, lower(trim(concat_ws(' ', coalesce(lang, ''), trim(source), trim(left(text, 1200))))) AS a, lower(trim(concat_ws(' ', coalesce(lang, ''), trim(source), trim(left(text, 2000))))) AS b FROM documents)
      SELECT doc_id, CASE {" ".join(f"WHEN {_holds('a', p)} THEN '{name}'" for name, p in narrative.SECTION_ROLES)} ELSE 'unknown' END AS role,
             concat_ws(',', {", ".join(f"CASE WHEN {_holds('b', p)} THEN '{name}' END" for name, p in narrative.TOPICS)}) AS topics FROM s""",
    "fact_values": """WITH v AS (SELECT event_id, value * pow(10.0, event_id % 4) AS x, value / 100 AS s FROM events)
      SELECT event_id, CASE WHEN x IS NULL THEN 'n/a' WHEN abs(x) >= 1e9 THEN format('{:,.0f}', x) WHEN abs(x) >= 1e3 THEN format('{:,.2f}', x) ELSE rtrim(rtrim(format('{:.4f}', x), '0'), '.') END AS shown,
             round(greatest(0::DOUBLE, least(1::DOUBLE, s)), 4) AS score FROM v""",
    "leak_check": r"""WITH q AS (SELECT item_id, regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]+', '', 'g') AS t FROM benchmark),
      d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]+', '', 'g') AS t FROM documents),
      a AS (SELECT DISTINCT item_id, substr(t, i, 16) AS w FROM (SELECT item_id, t, unnest(range(1, length(t) - 14)) AS i FROM q)),
      b AS (SELECT DISTINCT doc_id, substr(t, i, 16) AS w FROM (SELECT doc_id, t, unnest(range(1, length(t) - 14)) AS i FROM d) WHERE substr(t, i, 16) IN (SELECT w FROM a))
      SELECT item_id AS question_id, doc_id AS text_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL""",
    "question_plan": rf"""WITH {ASKED_SQL}, l AS (SELECT *, lower(t) AS low, trim(t) AS base FROM q),
      n AS (SELECT *,
        list_concat(list_filter(regexp_extract_all(t, '\b[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\b'), lambda x: x IN ('NetIncomeLoss', 'GrossProfitRatio2')),
          CASE WHEN contains(low, 'operating income') THEN ['OperatingIncomeLoss'] ELSE [] END, CASE WHEN contains(low, 'cost of revenue') THEN ['CostOfRevenue', 'CostOfGoodsAndServicesSold'] ELSE [] END,
          CASE WHEN contains(low, 'net income') OR contains(low, '净利润') THEN ['NetIncomeLoss', 'NetIncomeLossAttributableToParent', 'NetIncome'] ELSE [] END,
          CASE WHEN contains(low, 'revenue') THEN ['Revenues', 'Revenue', 'SalesRevenueNet', 'OperatingRevenues'] ELSE [] END, CASE WHEN contains(low, 'sales') THEN ['SalesRevenueNet', 'Revenues'] ELSE [] END,
          CASE WHEN contains(low, 'eps') THEN ['EarningsPerShareBasic', 'EarningsPerShareDiluted'] ELSE [] END) AS named,
        list_filter([CASE WHEN contains(low, '8-k/a') THEN '8-K/A' END, CASE WHEN contains(low, '10.k / a') THEN '10-K/A' END, CASE WHEN contains(low, '10-q') THEN '10-Q' END, CASE WHEN regexp_matches(low, '10[-.]?k') THEN '10-K' END, CASE WHEN contains(low, '8-k') THEN '8-K' END], lambda x: x IS NOT NULL) AS written,
        regexp_matches(low, 'annual|fy|年报') AS annual, regexp_matches(low, 'quarter|\bq2\b') AS quarterly,
        regexp_extract_all(t, '\b20[0-9][0-9]\b') AS years, regexp_extract_all(t, '20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]') AS dates,
        list_filter([CASE WHEN regexp_matches(low, 'management discussion|results of operations') THEN 'management_discussion' END, CASE WHEN regexp_matches(low, 'gross margin|cost of revenue') THEN 'margin_cost_structure' END, CASE WHEN contains(low, 'liquidity') THEN 'liquidity' END,
                     CASE WHEN contains(low, 'substantial doubt') THEN 'going_concern' END, CASE WHEN contains(low, 'risk factors') THEN 'risk_factors' END], lambda x: x IS NOT NULL) AS targets FROM l),
      u AS (SELECT *, list_filter(named, lambda x, i: list_position(named, x) = i)[1:16] AS metrics, list_filter(years, lambda x, i: list_position(years, x) = i)[1:6] AS ys,
        CASE WHEN len(written) > 0 THEN written WHEN annual AND NOT quarterly THEN ['10-K'] WHEN quarterly AND NOT annual THEN ['10-Q'] ELSE [] END AS forms FROM n),
      m AS (SELECT *, CASE WHEN len(ys) >= 2 OR regexp_matches(low, 'compare|trend') THEN 'cross_filing_compare' WHEN len(targets) > 0 THEN 'mixed_narrative_first' WHEN len(metrics) > 0 OR len(dates) > 0 THEN 'mixed_facts_first' ELSE 'facts_only' END AS mode,
        list_concat(flatten(list_transform(targets, lambda x: CASE x WHEN 'management_discussion' THEN ['md&a', 'management discussion', 'management''s discussion'] WHEN 'margin_cost_structure' THEN ['cost structure', 'cost of revenue', 'gross margin']
          WHEN 'liquidity' THEN ['liquidity', 'capital resources', 'working capital'] WHEN 'going_concern' THEN ['going concern', 'substantial doubt', '持续经营'] ELSE ['risk factors', '风险因素'] END)), metrics[1:6], forms, ys[1:4], dates[1:4]) AS terms FROM u)
      SELECT query_id, mode, array_to_string(metrics, ',') AS metrics, array_to_string(forms, ',') AS forms, array_to_string(dates, ',') AS period_dates, array_to_string(ys, ',') AS period_years, array_to_string(targets, ',') AS targets,
        array_to_string(list_filter(terms, lambda x, i: list_position(terms, x) = i)[1:16], ',') AS terms,
        CASE mode WHEN 'facts_only' THEN 80 WHEN 'cross_filing_compare' THEN 96 ELSE 56 END AS sql_rows, CASE mode WHEN 'facts_only' THEN 6 WHEN 'cross_filing_compare' THEN 12 ELSE 10 END AS summaries,
        CASE mode WHEN 'facts_only' THEN 10 WHEN 'cross_filing_compare' THEN 30 ELSE 24 END AS leaves, CASE mode WHEN 'facts_only' THEN 3 WHEN 'cross_filing_compare' THEN 8 ELSE 6 END AS per_filing,
        CASE mode WHEN 'facts_only' THEN 2 WHEN 'cross_filing_compare' THEN 4 ELSE 3 END AS second_pass, mode <> 'facts_only' AS narrative, true AS numeric, mode = 'cross_filing_compare' AS cross_filing,
        CASE WHEN len(metrics) > 0 THEN base || chr(10) || chr(10) || 'XBRL metrics: ' || array_to_string(metrics[1:12], ' ') ELSE base END AS retrieval_query,
        CASE WHEN mode = 'facts_only' THEN '' WHEN len(targets) = 0 THEN base ELSE base || chr(10) || chr(10) || 'Narrative focus: ' || array_to_string(list_transform(targets, lambda x: CASE x
          WHEN 'management_discussion' THEN 'Item 7 MD&A; management discussion and analysis; results of operations' WHEN 'margin_cost_structure' THEN 'gross margin; cost of revenue; operating expenses; cost structure'
          WHEN 'liquidity' THEN 'liquidity and capital resources; working capital; cash requirements' WHEN 'going_concern' THEN 'going concern; substantial doubt about ability to continue'
          ELSE 'Item 1A Risk Factors; concentration of revenue; customer dependence; major customers; single-customer risk' END)[1:4], '; ') END AS narrative_query FROM m""",
}
