"""Pages of Markdown cut into text and image chunks whose titles carry over from page to page. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIZE = 1000
PERCENT = 95.0
_PICTURE = r"!\[image\]\(([^)\s]+)\)"


def sections(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_no, md) -> document_id, page_no, section, title, body.

    A line of one to three # begins a section; its title is the last headings of levels 1 to 3,
    as `A --> B --> C`, where a heading ends those below it. What stands before a page's first
    heading has the title in force. Sections without heading and text are left out.
    """
    lines = pages.select("document_id", "page_no", F.posexplode(F.split(F.regexp_replace("md", r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", r"^(#{1,3})\s+\S", 1)
    read = lines.withColumn("level", F.nullif(F.length(marks), F.lit(0))).withColumn("header", F.trim(F.regexp_extract("line", r"^#{1,3}\s+(.*)$", 1)))
    so_far = W.partitionBy("document_id").orderBy("page_no", "pos").rowsBetween(W.unboundedPreceding, 0)
    placed = read.withColumn("section", F.sum(F.col("level").isNotNull().cast("long")).over(so_far))
    named = [F.last(F.when(F.col("level") == k, F.struct("section", "header")), ignorenulls=True).over(so_far).alias(f"h{k}") for k in (1, 2, 3)]
    ended = [F.coalesce(F.last(F.when(F.col("level") < k, F.col("section")), ignorenulls=True).over(so_far), F.lit(0)).alias(f"e{k}") for k in (1, 2, 3)]
    carried = placed.select("*", *named, *ended)
    title = F.concat_ws(" --> ", *[F.when(F.col(f"h{k}.section") > F.col(f"e{k}"), F.col(f"h{k}.header")) for k in (1, 2, 3)])
    kept = F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))
    grouped = carried.withColumn("title", title).groupBy("document_id", "page_no", "section", "title").agg(F.array_sort(kept).alias("kept"), F.count("level").alias("headed"))
    bodies = grouped.withColumn("body", F.trim(F.regexp_replace(F.array_join("kept.line", "\n"), r"^\s+|\s+$", "")))
    return bodies.filter("headed > 0 or body <> ''").select("document_id", "page_no", "section", "title", "body")


def fixed_pieces(text: Column, size: int) -> Column:
    """Pieces of `size` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(1 - dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(1.0))


def semantic_pieces(sentences: Column, vectors: Column, size: int = SIZE, percent: float = PERCENT) -> Column:
    """Sentences joined, cut where neighbours are further apart than the percentile of all distances and size / 4 characters are there.

    Without a vector for every sentence the joined text is cut at `size`.
    """
    n = F.size(sentences)
    steps = F.sequence(F.lit(1), n - 1)
    apart = F.transform(steps, lambda i: cosine_distance(F.get(vectors, i - 1), F.get(vectors, i)))
    bound = F.get(F.sort_array(apart), F.bround(percent / 100 * (n - 2), 0).cast("int"))

    def add(state: Column, i: Column) -> Column:
        cut = (F.get(apart, i - 1) > bound) & (F.length(state["held"]) >= size // 4)
        done = F.when(cut, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"])
        held = F.when(cut, F.get(sentences, i)).otherwise(F.concat(state["held"], F.get(sentences, i)))
        return F.struct(done.alias("done"), held.alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.get(sentences, F.lit(0)).alias("held"))
    folded = F.aggregate(steps, start, add, lambda s: F.concat(s["done"], F.when(F.trim(s["held"]) != "", F.array(s["held"])).otherwise(F.array().cast("array<string>"))))
    whole = F.size(F.filter(vectors, lambda v: v.isNotNull())) == n
    alone = F.filter(sentences, lambda s: F.trim(s) != "")
    return F.when(n <= 1, alone).when(F.coalesce(whole, F.lit(False)), folded).otherwise(fixed_pieces(F.array_join(sentences, ""), size))


def page_chunks(pages: DataFrame, size: int = SIZE) -> DataFrame:
    """document_id, page_no, section, place, kind, title, text, image_name: of each section the images, then its text in pieces of `size`."""
    found = sections(pages)
    names = F.regexp_extract_all("body", F.lit(_PICTURE), F.lit(1))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", _PICTURE, ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    image = lambda x: F.struct(F.lit("image").alias("kind"), F.lit("").alias("text"), x.alias("image_name"))
    text = lambda x: F.struct(F.lit("text").alias("kind"), F.trim(x).alias("text"), F.lit(None).cast("string").alias("image_name"))
    parts = F.concat(F.transform(names, image), F.filter(F.transform(fixed_pieces(clean, size), text), lambda c: c["text"] != ""))
    return found.select("document_id", "page_no", "section", "title", F.posexplode(parts).alias("place", "c")).select("document_id", "page_no", "section", "place", "c.kind", "title", "c.text", "c.image_name")
