"""Ingest runs: resume decision and log metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: log line patterns ------------------------------------------------
USAGE_WALL = "(?i)usage limit reached|5-hour usage limit|600/600|rate_limit_error"


def resume_point(runs: DataFrame, mode: str, as_of: str, force: bool = False) -> DataFrame:
    """What to do next given the newest run: ``decision, run_id, source_index, request_used``.

    A paused run that may not resume yet stays paused; a paused run of the same mode goes on
    at its source; anything else starts a new run at the first source.
    """
    newest = runs.agg(
        F.max_by(
            F.struct("run_id", "mode", "status", "source_index", "request_used", "next_resume_at"),
            F.struct("updated_at", "run_id"),
        ).alias("r")
    )
    r = lambda name: F.col(f"r.{name}")
    paused = F.coalesce(r("status") == "paused", F.lit(False))
    if force:
        paused = F.lit(False)
    waiting = paused & F.coalesce(r("next_resume_at") > F.lit(as_of).cast("timestamp"), F.lit(False))
    goes_on = paused & ~waiting & (r("mode") == mode)
    return newest.select(
        F.when(waiting, "stay_paused").when(goes_on, "continue").otherwise("new_run").alias("decision"),
        F.when(waiting | goes_on, r("run_id")).alias("run_id"),
        F.when(waiting | goes_on, r("source_index")).otherwise(0).alias("source_index"),
        F.when(waiting | goes_on, r("request_used")).otherwise(0).alias("request_used"),
    )


def run_totals(steps: DataFrame) -> DataFrame:
    """Checkpoint counters per run from its per-source steps (``outcome, flushed, skipped, requests``)."""
    ran = F.col("outcome").isin("done", "failed")
    return steps.groupBy("run_id").agg(
        F.count_if(ran).alias("sources_processed"),
        F.count_if(F.col("outcome") == "unhealthy").alias("sources_skipped"),
        F.count_if(F.col("outcome") == "failed").alias("sources_failed"),
        F.coalesce(F.sum(F.when(ran, F.col("flushed"))), F.lit(0)).alias("policies_upserted"),
        F.coalesce(F.sum(F.when(ran, F.col("skipped"))), F.lit(0)).alias("items_skipped"),
        F.coalesce(F.sum(F.when(ran, F.col("requests"))), F.lit(0)).alias("request_used"),
    )


def run_log_metrics(logs: DataFrame) -> DataFrame:
    """Counters of a run read from its log lines.

    Requests and flushed drafts come from the first line that reports them; without a report
    the upsert lines are counted.
    """
    line = F.col("line")

    def first_number(pattern: str):
        number = F.regexp_extract(line, pattern, 1)
        return F.min_by(F.when(number != "", number.try_cast("bigint")), F.when(number != "", F.col("line_no")))

    return (
        logs.groupBy("run_id")
        .agg(
            first_number(r"(?i)requests used:\s*(\d+)").alias("_requests"),
            first_number(r"(?i)Flushed\s+(\d+)\s+drafts").alias("_flushed"),
            first_number(r"(?i)Upserted\s+(\d+)\s+drafts").alias("_upserted"),
            F.count_if(line.rlike(r"(?i)^Upserted\s+.+$")).alias("_upsert_lines"),
            F.count_if(line.rlike(r"(?i)^Skipped\s+")).alias("skipped"),
            F.max(line.rlike(USAGE_WALL)).alias("hit_usage_wall"),
        )
        .select(
            "run_id",
            F.coalesce("_requests", F.lit(0)).alias("requests_used"),
            F.coalesce("_flushed", "_upserted", "_upsert_lines").alias("flushed"),
            "skipped",
            "hit_usage_wall",
        )
    )


# --- open JSON of runs ------------------------------------------------------------------
# keys of the checkpoint that have columns of their own: (column, path, type)
SHREDDED = [
    ("mode", "$.mode", "string"), ("source_index", "$.sourceIndex", "int"), ("request_budget", "$.requestBudget", "int"), ("request_used", "$.requestUsed", "int"),
    ("sources_processed", "$.totals.sourcesProcessed", "int"), ("policies_upserted", "$.totals.policiesUpserted", "int"), ("last_error", "$.lastError", "string"),
]


def open_checkpoints(runs: DataFrame, text: str = "checkpoint") -> DataFrame:
    """Run checkpoints as VARIANT, with the keys that queries use as columns.

    The whole object stays in ``state``: keys that nobody knows yet, and values of unexpected types, survive being stored and written
    back.  A known key of another type gives null in its column; text that is not JSON gives a null object.
    """
    rows = runs.withColumn("state", F.try_parse_json(text))
    return rows.select("*", *[F.try_variant_get("state", path, kind).alias(f"cp_{name}") for name, path, kind in SHREDDED])


def checkpoint_json(state: str = "state"):
    """Text of a stored checkpoint, keys in the order of their names."""
    return F.to_json(F.col(state))


def checkpoint_keys(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """``run_id, name, type, value`` of every top-level key of the checkpoints, known or not."""
    entries = rows.sparkSession.tvf.variant_explode(F.col("state").outer())
    found = rows.select(F.col(key).alias("_id"), "state").lateralJoin(entries)
    return found.select(F.col("_id").alias(key), F.col("key").alias("name"), F.schema_of_variant("value").alias("type"), F.col("value").cast("string").alias("value"))
