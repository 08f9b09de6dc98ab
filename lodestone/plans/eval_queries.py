"""Evaluation, job-queue and time-window queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import evaluation, trees
from lodestone.session import table


def mode_first_seen(spark, sf_dir):
    return evaluation.first_mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


def eval_panel(spark, sf_dir):
    """Per type and overall: rows, errors, mean of the others."""
    return spark.sql(
        """SELECT coalesce(event_type, 'all') AS panel, count(*) AS n, count_if(event_type = 'error') AS errors,
                  round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS mean_value
           FROM {events} GROUP BY GROUPING SETS ((event_type), ())""",
        events=table(spark, sf_dir, "events"),
    )


def p95_floor(spark, sf_dir):
    n = F.col("n")
    found = evaluation.elements_at(table(spark, sf_dir, "events"), ["event_type"], "value", {"p95": evaluation.floor_place(n, 0.95), "p50": evaluation.bankers_place(n, 50)})
    return found.select("event_type", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"))


def gate_compare(spark, sf_dir):
    """Mean value by type, of even users against odd ones; errors count as lower-better."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 2).alias("half")).agg(F.avg("value").alias("value"))
    side = lambda h: rows.filter(F.col("half") == h).select("metric", (F.col("metric") != "error").alias("higher_better"), "value")
    return evaluation.gate(side(0), side(1), 0.02).select("metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "change", "regression")


def ab_report(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    split = (F.col("user_id") % 2).alias("round")
    return table(spark, sf_dir, "events").groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.round(F.avg(F.when(F.col("event_type") != "error", k)), 6).alias("mean_k"), F.min(F.when(F.col("event_type") != "error", k)).alias("min_k"), F.max(F.when(F.col("event_type") != "error", k)).alias("max_k"),
    )


def queue_fifo(spark, sf_dir):
    """The oldest 50 pending jobs and which metrics they get."""
    pending = table(spark, sf_dir, "events").filter("event_type in ('view', 'click')")
    route = F.when(F.col("value") > 10, "with_reference").otherwise("without_reference")
    return pending.orderBy("ts", "event_id").limit(50).select("event_id", "ts", route.alias("route"))


def latest_index_line(spark, sf_dir):
    newest = F.max(F.struct("ts", "event_id", "event_type"))["event_id"]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest.alias("event_id"))


def rate_window(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts"), "60 seconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").alias("window_start"), "event_type", "n")


def session_counts(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy(F.session_window(F.col("ts"), "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("largest"))


def neighbors_band(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    seeds = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("seed_order"))
    return trees.neighbours(turns, seeds, "conv_id", "turn", 1).select("conv_id", "seed_order", "turn", "role")


def siblings(spark, sf_dir):
    """Up to 3 user turns of each conversation that has a system turn."""
    turns = table(spark, sf_dir, "conversations")
    seeds = turns.filter("role = 'system'").select("conv_id").distinct()
    return trees.first_per(turns.filter("role = 'user'").join(seeds, "conv_id", "left_semi"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "place")


def budget_prefix(spark, sf_dir):
    return trees.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text"), 1000).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


def nearest_context(spark, sf_dir):
    before, after = trees.nearest(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("user_before"), after.alias("user_after"))


def status_windows(spark, sf_dir):
    """Jobs per status in a half-open hour."""
    inside = table(spark, sf_dir, "events").filter("ts >= timestamp_ntz'2024-01-01 01:00:00' and ts < timestamp_ntz'2024-01-01 02:00:00'")
    return inside.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def section_carry(spark, sf_dir):
    """The system turn in force at each turn, carried forward until the next one."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "system", F.col("turn")), ignorenulls=True).over(w).alias("section"))


QUERIES = {f.__name__: f for f in (mode_first_seen, eval_panel, p95_floor, gate_compare, ab_report, queue_fifo, latest_index_line, rate_window, session_counts, neighbors_band, siblings, budget_prefix, nearest_context, status_windows, section_carry)}
ORACLES = {
    "mode_first_seen": """SELECT user_id, event_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p) AS r FROM
      (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p FROM events GROUP BY ALL)) WHERE r = 1""",
    "eval_panel": """SELECT coalesce(event_type, 'all') AS panel, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS mean_value
      FROM events GROUP BY GROUPING SETS ((event_type), ())""",
    "p95_floor": """SELECT event_type, round(list_sort(list(value))[CAST(floor(0.95 * (count(value) - 1)) AS BIGINT) + 1], 6) AS p95,
      round(list_sort(list(value))[CAST(round_even(0.5 * (count(value) - 1), 0) AS BIGINT) + 1], 6) AS p50 FROM events GROUP BY event_type""",
    "gate_compare": """WITH m AS (SELECT event_type AS metric, user_id % 2 AS half, avg(value) AS v FROM events GROUP BY ALL),
      j AS (SELECT c.metric, c.v AS value, b.v AS baseline, (c.v - b.v) / b.v AS change FROM m c JOIN m b ON b.metric = c.metric AND b.half = 1 WHERE c.half = 0)
      SELECT metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(change, 6) AS change, CASE WHEN metric <> 'error' THEN change < -0.02 ELSE change > 0.02 END AS regression FROM j""",
    "ab_report": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
      SELECT user_id % 2 AS round, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(k) FILTER (WHERE event_type <> 'error'), 6) AS mean_k,
             min(k) FILTER (WHERE event_type <> 'error') AS min_k, max(k) FILTER (WHERE event_type <> 'error') AS max_k FROM e GROUP BY 1""",
    "queue_fifo": "SELECT event_id, ts, CASE WHEN value > 10 THEN 'with_reference' ELSE 'without_reference' END AS route FROM events WHERE event_type IN ('view', 'click') ORDER BY ts, event_id LIMIT 50",
    "latest_index_line": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "rate_window": "SELECT time_bucket(INTERVAL 60 SECOND, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_counts": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
      SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY user_id""",
    "neighbors_band": "SELECT s.conv_id, s.turn AS seed_order, t.turn, t.role FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn BETWEEN s.turn - 1 AND s.turn + 1 WHERE s.role = 'assistant'",
    "siblings": """SELECT conv_id, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations
      WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')) WHERE place <= 3""",
    "budget_prefix": """SELECT conv_id, turn, used FROM (SELECT *, CAST(sum(length(text)) OVER w AS BIGINT) AS used, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
      WHERE used <= 1000 OR n = 1""",
    "nearest_context": """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_before,
      first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS user_after FROM conversations""",
    "status_windows": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01 01:00:00' AND ts < TIMESTAMP '2024-01-01 02:00:00' GROUP BY 1",
    "section_carry": "SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations",
}
