"""Streams: windowed counts with late data bounded, and a job queue drained batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_tables(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rate_counts(events: DataFrame, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events per fixed window and type; rows later than `late` behind the newest are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def drain(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """All pending jobs that are there, worked on and written; a batch that is tried again replaces what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows.filter("status = 'pending'")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit(times: list[float], start: float | None, count: int, limit: int, seconds: float) -> tuple[list[float], float | None, int]:
    """When each request is let through, and the window's start and count after them.

    A window begins with the first request after the last one ended and lets `limit` through;
    a request that finds it full waits for its end, where the next one begins.
    """
    out = []
    for time in times:
        now = time if not out else max(time, out[-1])
        if start is None or now - start >= seconds:
            start, count = now, 0
        if count >= limit:
            start, count = start + seconds, 0
            now = start
        out.append(now)
        count += 1
    return out, start, count


def admitted(requests: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """requests(key, request_id, at) with admitted_at, each key with windows of its own; state is a start and a count a key."""

    def run(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        start, count, last = state.get if state.exists else (None, 0, None)
        times = rows["at"].tolist() if last is None else [max(t, last) for t in rows["at"].tolist()]
        let_in, start, count = admit(times, start, count, limit, seconds)
        state.update((start, count, let_in[-1]))
        yield rows.assign(admitted_at=let_in)[["key", "request_id", "at", "admitted_at"]]

    schema = "key string, request_id long, at double, admitted_at double"
    return requests.groupBy("key").applyInPandasWithState(run, schema, "start double, count long, last double", "append", "NoTimeout")


def latest_status(changes: DataFrame, final: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """changes(document_id, status, at) -> the status of each document; a final one is not left again, and the first one counts."""
    done = F.min(F.when(F.col("status").isin(*final), F.struct("at", "status")))["status"]
    return changes.groupBy("document_id").agg(F.coalesce(done, F.max_by("status", "at")).alias("status"))
