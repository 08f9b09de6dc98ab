"""Reports kept as JSON records with an index that is only appended to; a later line for a trace replaces earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDEX = "trace_id string, created_at string, source string, question string, document_ids array<long>, latency_ms double, confidence double"
RECORD = f"{INDEX}, response string, evidence map<string,string>"


def record(rows: DataFrame, slim: bool = True, evidence_chars: int | None = None) -> DataFrame:
    """rows(RECORD) as they are stored: blank trace ids get one from their content, slim ones lose the trace in the response."""
    own = F.nullif(F.trim("trace_id"), F.lit(""))
    made = F.left(F.sha2(F.concat_ws("\u0001", "created_at", "question", "response"), 256), F.lit(32))
    out = rows.withColumn("trace_id", F.coalesce(own, made))
    if slim:
        out = out.withColumn("response", F.to_json(F.map_filter(F.from_json("response", "map<string,string>"), lambda k, _: ~k.isin("pipeline_trace", "full_retrieval_debug"))))
    if evidence_chars is not None:
        out = out.withColumn("evidence", F.transform_values("evidence", lambda _, v: F.left(v, F.lit(evidence_chars))))
    return out


def save(rows: DataFrame, folder: str, slim: bool = True, evidence_chars: int | None = None) -> None:
    """Appends records and lines of the index; a rerun adds the same lines again, which listing takes once."""
    kept = record(rows, slim, evidence_chars)
    kept.write.mode("append").json(f"{folder}/records")
    kept.select("trace_id", "created_at", "source", "question", "document_ids", "latency_ms", "confidence").write.mode("append").json(f"{folder}/index")


def listed(index: DataFrame, limit: int = 50) -> DataFrame:
    """The latest line of each trace, the newest first."""
    lines = index.filter("coalesce(trace_id, '') <> ''")
    latest = W.partitionBy("trace_id").orderBy(F.desc_nulls_last("created_at"))
    return lines.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n").orderBy(F.desc_nulls_last("created_at"), "trace_id").limit(max(1, limit))


def load(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """`records` or `index`; lines that don't parse are left out."""
    schema = RECORD if part == "records" else INDEX
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{part}").filter("trace_id is not null")


def delete(spark: SparkSession, folder: str, to: str, trace_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes what is left under `to` and gives (deleted, missing) trace ids; the old folder is the caller's to drop."""
    wanted = trace_ids.select(F.trim("trace_id").alias("trace_id")).filter("trace_id <> ''").distinct()
    for part in ("records", "index"):
        load(spark, folder, part).join(wanted, "trace_id", "left_anti").write.mode("overwrite").json(f"{to}/{part}")
    known = load(spark, folder, "records").select("trace_id").distinct()
    return wanted.join(known, "trace_id", "left_semi"), wanted.join(known, "trace_id", "left_anti")
