"""Company facts JSON flattened to one row per observation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import number_of

_ENTRY = "struct<val:string,end:string,filed:string,form:string,fy:int,fp:string,accn:string,frame:string>"
SCHEMA = f"struct<cik:long,entityName:string,facts:map<string,map<string,struct<label:string,description:string,units:map<string,array<{_ENTRY}>>>>>>"


def is_companyfacts(payload):
    """Whether a JSON text has a cik and an object of facts."""
    return F.get_json_object(payload, "$.cik").isNotNull() & F.coalesce(F.get_json_object(payload, "$.facts").startswith("{"), F.lit(False))


def flatten(documents: DataFrame) -> DataFrame:
    """documents(document_id, payload) -> an observation per (taxonomy, metric, unit, entry); truth values give neither number nor text."""
    parsed = documents.filter(is_companyfacts(F.col("payload"))).select("document_id", F.from_json("payload", SCHEMA).alias("d"))
    metrics = parsed.select("document_id", "d.cik", F.col("d.entityName").alias("entity_name"), F.explode("d.facts").alias("taxonomy", "metrics")).select("*", F.explode("metrics").alias("metric_key", "m"))
    entries = metrics.select("document_id", "cik", "entity_name", "taxonomy", "metric_key", "m.label", "m.description", F.explode("m.units").alias("unit", "entries")).select("*", F.posexplode("entries").alias("pos", "e"))
    value = F.col("e.val")
    truth = F.lower(value).isin("true", "false")
    number = F.when(~truth, number_of(value))
    return entries.select(
        "document_id", "cik", "entity_name", "taxonomy", "metric_key", F.col("label").alias("metric_label"), F.col("description").alias("metric_description"), "unit", "pos",
        number.alias("value_numeric"),
        F.when(number.isNull() & ~truth, F.nullif(F.trim(value), F.lit(""))).alias("value_text"),
        F.expr("try_to_date(left(e.end, 10))").alias("period_end"),
        F.expr("try_to_date(left(e.filed, 10))").alias("filed_date"),
        "e.form", "e.fy", F.upper(F.trim("e.fp")).alias("fp"), "e.accn", "e.frame",
    )
