"""The queries over the driver's tables that apply each operator of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, exact_dedup, fill_middle, lm_scoring, mixing, packing, personal_data, quality_rules, resampling, simhash, substring_dedup, toxicity, warc
from lodestone.llm.staging import Staged
from lodestone.session import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what `labels` says is of good quality."""
    targets = table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_scoring.score(table(spark, sf_dir, "documents"), targets)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's second capture, resolved; the payload as its length and digest, headers in one line.

    The captures are written as WARC files and read from them. Pages without an id have no time and are `missing`.
    """
    captures = warc.captures(table(spark, sf_dir, "pages"))
    files = Staged(warc.archived(captures.withColumn("time", F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))))
    records = Staged(warc.read_records(files.df))
    files.drop()
    found = warc.resolve(records.df).withColumn("payload", F.col("payload").cast("string"))
    page = lambda c: F.substring(c, 2, 19).cast("long")
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(
        page("record_id").alias("page_id"), "canonical_url", page("refers_to").alias("refers_to"), "status", line.alias("headers"),
        F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"),
    )


OP8_SQL = r"""
WITH bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b, coalesce(html, '') AS page FROM pages),
parts AS (
  SELECT *, regexp_extract(b, '^[^?]*', 0) AS address, regexp_extract(b, '\?(.*)$', 1) AS query FROM bare),
named AS (
  SELECT page_id, page, md5(page) AS etag,
         regexp_replace(lower(regexp_extract(address, '^[^/]*', 0)), '^www\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_extract(address, '/.*$', 0), '/+$', '') AS place,
         list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|session)(=|$)'))) AS kept
  FROM parts),
urls AS (SELECT *, place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM named),
found AS (
  SELECT r.*, (SELECT max(f.page_id) FROM urls f WHERE f.canonical_url = r.canonical_url AND 2 * f.page_id < 2 * (r.page_id + 1000) + 1) AS stored
  FROM urls r),
judged AS (SELECT f.*, s.page AS stored_page, s.etag = f.etag AS same FROM found f LEFT JOIN urls s ON s.page_id = f.stored)
SELECT page_id, canonical_url, CASE WHEN same THEN stored END AS refers_to,
       CASE WHEN stored IS NULL THEN 'missing' WHEN same THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN same THEN 'content-length=' || CAST(octet_length(encode(stored_page)) AS VARCHAR) || ';content-type=text/html;date='
            || CAST(2 * (page_id + 1000) + 1 AS VARCHAR) || ';etag=' || etag END AS headers,
       CASE WHEN same THEN length(stored_page) END AS payload_chars, CASE WHEN same THEN md5(stored_page) END AS payload_md5
FROM judged
"""


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link_tool_calls(chat.conversations(table(spark, sf_dir, "conversations")), chat.SCHEMAS)
    return linked.withColumn("violations", F.array_join("violations", ","))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, range-sorted by its position in training (0 to 1); those that the mix doesn't take come last."""
    found = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return found.withColumn("position", F.round("position", 9))


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sources),
weighed AS (SELECT *, CAST(k % 3 + 1 AS BIGINT) AS weight, CAST((k % 3 - 1) / 2 AS DOUBLE) AS tilt, 3 * source_size AS most FROM ranked),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT)
             - CAST(coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size, tilt,
         CASE WHEN most <= level * weight THEN CAST(most AS DOUBLE)
              ELSE (SELECT level FROM levels WHERE most > level * weight ORDER BY most / weight, k LIMIT 1) * weight END AS target
  FROM levels),
lined AS (
  SELECT s.*, g.source_size, g.target, g.tilt,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken,
       CASE WHEN copies > 0 AND target > 0 THEN
         round(2 * share / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)), 9) END AS position
FROM (SELECT *, CAST((CASE WHEN 2 * begins + size < 2 * target THEN 1 ELSE 0 END)
                   + (CASE WHEN 2 * (source_size + begins) + size < 2 * target THEN 1 ELSE 0 END)
                   + (CASE WHEN 2 * (2 * source_size + begins) + size < 2 * target THEN 1 ELSE 0 END) AS BIGINT) AS copies,
             CASE WHEN target > 0 THEN least(1.0, begins / target) END AS share
      FROM lined)
"""


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and, if drawn, rank; the target is all of `benchmark`. Nulls and repeats as in resampling.resample."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cut, with digests of the output and of the text rebuilt from it. Nulls and repeats as in fill_middle.fill_middle."""
    found = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
h AS (SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(hex, k, 8) AS BIGINT)) AS h FROM drawn),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans (counted, and their digest) and all its spans. Nulls and repeats as in personal_data.personal_data."""
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_tool_calls": op9_tool_calls,
    "op10_mixing": op10_mixing,
    "op11_resampling": op11_resampling,
    "op12_fill_middle": op12_fill_middle,
    "op13_personal_data": op13_personal_data,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op8_warc_revisits": OP8_SQL, "op10_mixing": OP10_SQL, "op12_fill_middle": OP12_SQL}
