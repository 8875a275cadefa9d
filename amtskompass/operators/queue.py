"""Work queue: enqueue, claim, resolve, settle and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_ATTEMPTS
from ..functions.text import trim_all


def enqueue_jobs(queue: DataFrame, jobs: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """Replace the queue rows of jobs that need tagging.

    Those are active jobs whose detail fetch (``refnr, description``) succeeded, and active
    jobs that already have a description of more than 50 trimmed characters.  Their old rows
    are deleted and one pending row per job is inserted.
    """
    active = jobs.where("is_active")
    described = active.where(F.length(trim_all(F.coalesce("description_de", F.lit("")))) > 50)
    got = fetched.where(F.coalesce("description", F.lit("")) != "")
    due = active.select("refnr").join(
        described.select("refnr").union(got.select("refnr")).distinct(), "refnr", "left_semi"
    ).distinct()
    dropped = due.select(F.lit("job").alias("source_type"), F.col("refnr").alias("source_id"))
    kept = queue.join(dropped, ["source_type", "source_id"], "left_anti").select(*queue.columns)
    fresh = due.select(
        F.sha1(F.concat(F.lit("job:"), "refnr", F.lit(f"@{as_of}"))).alias("id"),
        F.lit("job").alias("source_type"),
        F.col("refnr").alias("source_id"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(1).alias("priority"),
        F.lit(0).alias("attempts"),
        F.lit(MAX_ATTEMPTS).alias("max_attempts"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )
    return kept.unionByName(fresh, allowMissingColumns=True).select(*queue.columns)


def claim_order() -> list[Column]:
    return [F.col("priority").desc_nulls_first(), F.col("created_at").asc_nulls_last(), F.col("id").asc()]


def next_items(queue: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pending items to work on next."""
    return queue.where(F.col("status") == "pending").orderBy(*claim_order()).limit(n)


def claim(queue: DataFrame, n: int = 5) -> DataFrame:
    """Queue after claiming the next ``n`` items: processing, each with its own attempt counted."""
    taken = F.broadcast(next_items(queue, n).select("id", F.lit(True).alias("_taken")))  # n rows
    rows = queue.join(taken, "id", "left")
    hit = F.coalesce("_taken", F.lit(False))
    updates = {"status": F.when(hit, "processing").otherwise(F.col("status")), "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts"))}
    return rows.withColumns(updates).select(*queue.columns)


def resolve_queue(queue: DataFrame, policies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Work items with the row they point to; a missing row gives an error message instead."""
    pages = policies.select(
        F.lit("policy").alias("source_type"), F.col("id").cast("string").alias("source_id"),
        F.col("title_de").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(True).alias("found"),
    )
    posts = jobs.select(
        F.lit("job").alias("source_type"), F.col("refnr").cast("string").alias("source_id"),
        F.col("title_de").alias("title"), F.coalesce("description_de", F.lit("")).alias("description"), F.lit(True).alias("found"),
    )
    rows = queue.join(pages.unionByName(posts), ["source_type", "source_id"], "left")
    name = F.initcap("source_type")
    return rows.withColumns(
        {
            "found": F.coalesce("found", F.lit(False)),
            "error": F.when(F.col("found").isNull(), F.concat(name, F.lit(" "), "source_id", F.lit(" not found"))),
        }
    )


def settle(queue: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Queue after folding outcomes (``id, ok, message``) in.

    Success ends an item; an error counts an attempt and fails the item at the third one.
    ``processed_at`` is set only when an item is finished.
    """
    o = outcomes.select(F.col("id").alias("o_id"), "ok", "message")
    rows = queue.join(o, F.col("id") == F.col("o_id"), "left")
    hit, ok = F.col("o_id").isNotNull(), F.coalesce(F.col("ok"), F.lit(False))
    attempts = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    failed = attempts >= MAX_ATTEMPTS
    stamp = F.lit(as_of).cast("timestamp")
    updates = {
        "status": F.when(~hit, F.col("status")).when(ok, "done").when(failed, "failed").otherwise("pending"),
        "attempts": F.when(hit & ~ok, attempts).otherwise(F.col("attempts")),
        "error_message": F.when(hit & ~ok, F.substring("message", 1, 500)).otherwise(F.col("error_message")),
        "processed_at": F.when(~hit, F.col("processed_at")).when(ok | failed, stamp),
    }
    return rows.withColumns(updates).select(*queue.columns)


# --- fixed values: characters of a description sent per round -----------------------
ROUND_CAPS = {1: 3000, 2: 3000, 3: 1500}


def retry_plan(outcomes: DataFrame) -> DataFrame:
    """Next step of every item given its round and success.

    Round 1 is the batch, round 2 repeats the failed ones as a batch; only when that repeat
    brought no success in the batch do its items go on as singles with a shorter text (round
    3); the rest is final.  ``outcomes`` has ``batch_id, key, round, ok``.
    """
    batch_ok = outcomes.groupBy("batch_id", "round").agg(F.max(F.col("ok").cast("int")).alias("any_ok"))
    rows = outcomes.join(batch_ok, ["batch_id", "round"])
    step = (
        F.when(F.col("ok"), "done")
        .when(F.col("round") == 1, "retry_batch")
        .when((F.col("round") == 2) & (F.col("any_ok") == 0), "retry_single")
        .otherwise("failed")
    )
    next_round = F.when(step.startswith("retry"), F.col("round") + 1)
    cap = F.when(next_round == 2, ROUND_CAPS[2]).when(next_round == 3, ROUND_CAPS[3])
    return rows.select("batch_id", "key", "round", step.alias("step"), next_round.alias("next_round"), cap.alias("text_cap"))
