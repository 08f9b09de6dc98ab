"""Queries over files made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.session import table
from lodestone.sources import files


def files_parsed(spark, sf_dir):
    """Every document as a file in one of seven encodings or types, read back; texts as digests."""
    i, text = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    western = text.rlike(r"^[\x00-\x7e\x{a0}-\x{ff}]*$")
    mark = lambda code: F.unhex(F.lit(code))
    utf8 = F.encode(text, "UTF-8")
    content = (
        F.when(i == 1, F.concat(mark("EFBBBF"), utf8)).when(i == 2, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).when(i == 3, F.encode(text, "UTF-16BE"))
        .when((i == 4) & western, F.encode(F.when(western, text).otherwise(""), "ISO-8859-1")).when(i == 5, F.encode(F.concat(F.lit("<html><script>x</script><p>"), F.regexp_replace(text, "[<&]", " "), F.lit("</p></html>")), "UTF-8")).otherwise(utf8)
    )
    kind = F.when(i == 5, ".HTML").when(i == 6, "pdf").otherwise("txt")
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), kind.alias("file_type"))
    found = files.parsed(made)
    return found.select(F.col("path").cast("long").alias("doc_id"), "file_type", "success", "error", F.md5("text").alias("text_md5"), "char_count")


QUERIES = {f.__name__: f for f in (files_parsed,)}
ORACLES = {
    "files_parsed": r"""WITH d AS (SELECT doc_id, doc_id % 7 AS i, CASE WHEN doc_id % 7 = 5 THEN regexp_replace(regexp_replace(coalesce(text, ''), '[<&]', ' ', 'g'), '\s+', ' ', 'g') ELSE coalesce(text, '') END AS t FROM documents),
      c AS (SELECT doc_id, i, array_to_string(list_filter(list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM d)
      SELECT doc_id, CASE i WHEN 5 THEN 'html' WHEN 6 THEN 'pdf' ELSE 'txt' END AS file_type, i <> 6 AND t <> '' AS success, CASE WHEN i = 6 THEN 'needs a reader of its own' WHEN t = '' THEN 'empty' END AS error,
        CASE WHEN i <> 6 AND t <> '' THEN md5(t) END AS text_md5, CASE WHEN i <> 6 AND t <> '' THEN length(t) END AS char_count FROM c""",
}
