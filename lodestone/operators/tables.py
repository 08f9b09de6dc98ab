"""Changes to tables of files: upserts, replacement, reports, sets, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(current: DataFrame, changes: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """current with changes put over it by key: their columns win where not null, metadata maps are merged, theirs last."""
    fresh = changes.select(*[F.col(c).alias(f"__{c}") for c in changes.columns])
    joined = current.join(fresh, F.col(key) == F.col(f"__{key}"), "full_outer")
    empty = F.create_map().cast("map<string,string>")

    def merged(c: str):
        if c == metadata:
            old, new = F.coalesce(F.col(c), empty), F.coalesce(F.col(f"__{c}"), empty)
            kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
            return F.map_concat(kept, new).alias(c)
        return F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changes.columns else F.col(c)

    return joined.select(*[merged(c) for c in current.columns])


def replaced(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """current with all rows of the keys in `rows` replaced by those."""
    return current.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def write_replacing(rows: DataFrame, path: str, key: str) -> None:
    """Overwrites only the partitions of the keys that occur."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def deleted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without the ids, ids that were there, ids that were not)."""
    known = rows.select(key).distinct()
    return rows.join(ids, key, "left_anti"), ids.join(known, key, "left_semi"), ids.join(known, key, "left_anti")


def completed(jobs: DataFrame) -> DataFrame:
    """jobs(status, error, skipped_reason, scores, metadata) with the final status; scores that are numbers are merged into metadata."""
    good = F.map_filter("scores", lambda _, v: v.isNotNull() & ~F.isnan(v))
    scores = F.transform_values(F.coalesce(good, F.create_map().cast("map<string,double>")), lambda _, v: v.cast("string"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("skipped_reason").isNotNull(), "skipped").otherwise("completed")
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(scores), k))
    return jobs.withColumn("metadata", F.map_concat(kept, scores)).withColumn("status", status)


def next_id(rows: DataFrame, taken: DataFrame, key: str) -> int:
    """The least id above all of rows that `taken` doesn't hold."""
    first = (rows.agg(F.max(key)).first()[0] or 0) + 1
    above = taken.filter(F.col(key) >= first).select(key).distinct()
    place = above.withColumn("n", F.row_number().over(W.orderBy(key)) - 1)
    run = place.filter(F.col(key) - F.col("n") == first).count()
    return first + run


def parsed_ids(text: str) -> list[int]:
    """`9801,9805-9807` -> 9801, 9805, 9806, 9807."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        found.update(range(int(low), int(high or low) + 1))
    return sorted(found)


def set_violations(sets: DataFrame, most_ids: int = 500) -> DataFrame:
    """sets(set_id, name, kind, chunk_ids, has_filter) that break a rule, with the rule."""
    rule = (
        F.when(~F.col("kind").isin("filter", "enumerated"), "unknown kind")
        .when((F.col("kind") == "filter") & (F.coalesce(F.size("chunk_ids"), F.lit(0)) > 0), "filter set with ids")
        .when((F.col("kind") == "enumerated") & F.col("has_filter"), "enumerated set with a filter")
        .when(F.size("chunk_ids") > most_ids, "too many ids")
        .when(F.count(F.lit(1)).over(W.partitionBy("name")) > 1, "name used twice")
    )
    return sets.withColumn("violation", rule).filter("violation is not null").select("set_id", "violation")


def rebuilt_texts(nodes: DataFrame, built: Column, by: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(nodes whose text differs from `built`, with it; per `by` the rows seen and changed). Running it on its own result changes nothing."""
    fresh = nodes.withColumn("__text", built)
    differs = ~F.col("text").eqNullSafe(F.col("__text"))
    changed = fresh.filter(differs).withColumn("text", F.col("__text")).drop("__text")
    return changed, fresh.groupBy(by).agg(F.count(F.lit(1)).alias("seen"), F.count_if(differs).alias("changed"))


def without_documents(stores: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every store without the documents, in the order given: indexes and files first and the document table last, so that a broken run can be repeated."""
    gone = ids.select(key).distinct()
    return {name: rows.join(gone, key, "left_anti") for name, rows in stores.items()}


def copy_differences(source: DataFrame, target: DataFrame, key: str = "name") -> DataFrame:
    """Files(key, content) that are missing, extra, or differ in size or md5 between two stores."""
    seen = lambda rows, side: rows.select(key, F.length("content").alias(f"{side}_size"), F.md5("content").alias(f"{side}_md5"))
    both = seen(source, "source").join(seen(target, "target"), key, "full_outer")
    what = (
        F.when(F.col("target_md5").isNull(), "missing").when(F.col("source_md5").isNull(), "extra")
        .when(F.col("source_size") != F.col("target_size"), "size").when(F.col("source_md5") != F.col("target_md5"), "content")
    )
    return both.withColumn("difference", what).filter("difference is not null").select(key, "difference")


def kept_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    """jobs(job_id, status, created_at): all that run, and the newest finished ones as far as `most` leaves room."""
    over = W.orderBy(F.col("status").isin("completed", "failed"), F.desc_nulls_last("created_at"), "job_id")
    finished = F.col("status").isin("completed", "failed")
    return jobs.withColumn("__n", F.row_number().over(over)).filter(~F.coalesce(finished, F.lit(False)) | (F.col("__n") <= most)).drop("__n")


def cleanup_blockers(known: DataFrame, on_disk: DataFrame, expected_rows: int | None = None) -> list[str]:
    """Why orphans on disk must not be deleted: nothing is known of what is in use, or less was read than is there."""
    read = known.count()
    reasons = []
    if read == 0 and not on_disk.isEmpty():
        reasons.append("nothing known while files exist")
    if expected_rows is not None and read < expected_rows:
        reasons.append(f"read {read} of {expected_rows} rows")
    return reasons
