"""Question files, checkpoints of batches, and catalogs of filings from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_text(item: Column, keys: tuple[str, ...]) -> Column:
    """The first of the fields of a JSON object that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(item, f"$.{k}")), F.lit("")) for k in keys])


def questions(files: DataFrame, raw: str = "value") -> DataFrame:
    """(id, question) of JSON files that are a list of objects or an object with `questions`; other files and items give none.

    The text is in question, question_text or query, the id in id, qid or question_id; without one it is the item's number.
    """
    listed = F.when(F.ltrim(raw).startswith("{"), F.get_json_object(raw, "$.questions")).otherwise(F.col(raw))
    items = files.select(F.posexplode(F.from_json(listed, "array<string>")).alias("place", "item")).filter("ltrim(item) like '{%'")
    text = first_text(F.col("item"), ("question", "question_text", "query"))
    found = items.select(F.coalesce(first_text(F.col("item"), ("id", "qid", "question_id")), (F.col("place") + 1).cast("string")).alias("id"), text.alias("question"))
    return found.filter("question is not null")


def pending(items: DataFrame, progress: DataFrame, attempts: int = 3) -> DataFrame:
    """Items that progress(id, status, attempts) neither finished nor gave up."""
    done = progress.filter((F.col("status") == "ok") | (F.col("attempts") >= attempts)).select("id").distinct()
    return items.join(done, "id", "left_anti")


def finished(items: DataFrame, progress: DataFrame) -> DataFrame:
    """The items that have a reference, with it."""
    good = progress.filter("status = 'ok' and trim(coalesce(reference, '')) <> ''").select("id", "reference").dropDuplicates(["id"])
    return items.join(good, "id")


def recent_filings(submissions: DataFrame, raw: str = "value") -> DataFrame:
    """(accession, filed, form, document) from columnar submissions; arrays shorter than the accessions' are filled with blanks."""
    names = {"accessionNumber": "accession", "filingDate": "filed", "form": "form", "primaryDocument": "document"}
    column = lambda k: F.coalesce(F.from_json(F.get_json_object(raw, f"$.filings.recent.{k}"), "array<string>"), F.array().cast("array<string>"))
    zipped = submissions.select(*[column(k).alias(n) for k, n in names.items()]).select(F.explode(F.arrays_zip(*[F.col(n) for n in names.values()])).alias("r"))
    rows = zipped.select(*[F.trim(F.coalesce(F.col(f"r.{n}"), F.lit(""))).alias(n) for n in names.values()])
    return rows.filter("accession <> ''")


def largest_body(files: DataFrame, by: list[str]) -> DataFrame:
    """by, name: the largest .htm or .html of files(*by, position, name, size) that is no index; the first of equally large ones. Sizes that are no numbers are 0."""
    low = F.lower(F.trim("name"))
    pages = files.filter(low.rlike(r"\.html?$") & ~low.contains("index.htm"))
    size = F.coalesce(F.when(F.trim("size").rlike(r"^\d+$"), F.trim("size").try_cast("long")), F.lit(0))
    return pages.groupBy(*by).agg(F.max_by(F.trim("name"), F.struct(size, -F.col("position"))).alias("name"))
