"""Replies back onto rows: reconciliation, enrichment, drafts, reviews, activation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import normalize_date
from ..functions.keys import content_hash, feed_slug
from ..functions.replies import (
    json_object_text, list_or, normalize_action, normalize_confidence, normalize_review_status, normalize_risk,
    normalize_status, text_or,
)
from ..functions.taxonomy import ingest_category, ingest_groups, ingest_level, ingest_text
from ..sources.schemas import POLICY_REPLY, REVIEW_REPLY
from .ranking import first_by


def last_reply(replies: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last reply row per key: a partial top-1 in each task, then one candidate per key and task is compared."""
    named = replies.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return first_by(named, [key], [F.col(c).desc_nulls_last() for c in order])


def reconcile(batch: DataFrame, replies: DataFrame, key: str, required: str | None, order: Sequence[str]) -> DataFrame:
    """Work rows with their reply fields (prefixed ``r_``) and ``ok``.

    A row succeeds when a reply exists for its key and the required field is present in it.
    """
    last = last_reply(replies, key, order)
    renamed = last.withColumnsRenamed({c: f"r_{c}" for c in last.columns})
    rows = batch.join(renamed, F.col(key) == F.col(f"r_{key}"), "left")
    ok = F.col(f"r_{key}").isNotNull()
    if required:
        ok = ok & F.col(f"r_{required}").isNotNull()
    return rows.withColumn("ok", ok).drop(f"r_{key}")


# --- fixed values: fields written per kind of enrichment -----------------------------
ENRICHED_FIELDS = {
    "job_description": ["description_zh", "tags"],
    "job_title": ["title_zh"],
    "job_tags": ["tags"],
    "policy_guide": [
        "title_zh", "summary_zh", "requirements_zh", "fees_zh", "duration_zh", "steps_zh", "category", "tags",
    ],
}
REQUIRED_FIELD = {
    "job_description": "description_zh", "job_title": "title_zh", "job_tags": "tags", "policy_guide": None,
}
MARKS_TRANSLATED = {"job_description", "policy_guide"}


def apply_enrichment(df: DataFrame, replies: DataFrame, kind: str, key: str, order: Sequence[str], as_of: str) -> DataFrame:
    """Rows with the fields of their successful reply written; one join on the key.

    Missing texts become empty and missing lists become empty lists.  Descriptions and guides
    also mark the row as translated; titles and tags alone do not.
    """
    fields = [c for c in ENRICHED_FIELDS[kind] if c in df.columns]
    rows = reconcile(df, replies, key, REQUIRED_FIELD[kind], order)
    types = dict(df.dtypes)
    updates: dict[str, Column] = {}
    for name in fields:
        new = F.col(f"r_{name}") if f"r_{name}" in rows.columns else F.lit(None)
        empty = F.array().cast(types[name]) if types[name].startswith("array") else F.lit("")
        updates[name] = F.when(F.col("ok"), F.coalesce(new.cast(types[name]), empty)).otherwise(F.col(name))
    if kind in MARKS_TRANSLATED:
        updates["translated"] = F.col("ok") | F.col("translated")
        updates["translated_at"] = F.when(F.col("ok"), F.lit(as_of).cast("timestamp")).otherwise(F.col("translated_at"))
    return rows.withColumns(updates).select(*df.columns)


def is_complete(mode: str = "length") -> Column:
    """All of description, translated description and translated title are there."""
    present = F.col("description_de").isNotNull() & F.col("description_zh").isNotNull() & F.col("title_zh").isNotNull()
    if mode == "null_only":
        return present
    return present & (F.length("description_de") > 20) & (F.length("description_zh") > 0) & (F.length("title_zh") > 0)


def activation(jobs: DataFrame, mode: str = "length", delisted: DataFrame | None = None) -> DataFrame:
    """A job is active exactly when it is complete.

    The rule re-activates complete jobs that were delisted; pass their keys as ``delisted`` to
    keep those inactive.
    """
    complete = F.coalesce(is_complete(mode), F.lit(False))
    rows = jobs
    if delisted is not None:
        gone = delisted.select("refnr").distinct().withColumn("_gone", F.lit(True))
        rows = jobs.join(gone, "refnr", "left")
        complete = complete & F.col("_gone").isNull()
    return rows.withColumn("is_active", complete).select(*jobs.columns)


def parsed_object(reply: Column, schema: T.StructType) -> Column:
    """Reply object as a struct; null when there is no readable object."""
    text = json_object_text(reply)
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def review_records(policies: DataFrame, replies: DataFrame, order: Sequence[str], model: str = "") -> DataFrame:
    """Review record of every policy with a reply (``policy_id, reply_text, source_text, error``).

    Fetch errors and unreadable replies give an uncertain record for manual checking.
    """
    rows = policies.select("id", "slug", "official_url").join(
        last_reply(replies, "policy_id", order), F.col("id") == F.col("policy_id")
    )
    r = F.col("_reply")
    rows = rows.withColumn("_reply", F.when(F.col("error").isNull(), parsed_object(F.col("reply_text"), REVIEW_REPLY)))
    ok = r.isNotNull()
    message = F.coalesce("error", F.lit("reply without a readable JSON object"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("id").alias("policy_id"),
        F.col("slug").alias("policy_slug"),
        "official_url",
        F.when(ok, normalize_review_status(r["reviewStatus"])).otherwise("uncertain").alias("review_status"),
        F.when(ok, normalize_confidence(F.coalesce(r["confidence"], F.lit("")))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, list_or(r["findings"], none)).otherwise(F.array(message)).alias("findings"),
        F.when(ok, normalize_action(r["suggestedAction"])).otherwise("manual_check").alias("suggested_action"),
        F.when(ok, text_or(r["reviewSummary"], F.lit(C.REVIEW_DONE_SUMMARY)))
        .otherwise(C.REVIEW_FAILED_SUMMARY).alias("review_summary"),
        F.lit(model).alias("reviewed_model"),
        F.when(ok, content_hash(F.col("source_text"), "sha256")).alias("source_hash"),
    )


def drafts_from_replies(items: DataFrame, replies: DataFrame, sources: DataFrame, as_of: str, order: Sequence[str],
                        status: str = "draft") -> DataFrame:
    """Draft rows of feed items from their replies: reply field, else feed item, else default.

    ``items`` has ``source_id, title, link, description, published_at``; ``replies`` has
    ``link, reply_text``.  Items without a readable reply or judged irrelevant are left out.
    """
    config = sources.select(
        F.col("id").alias("source_id"), F.col("publisher").alias("s_publisher"), F.col("regionLevel").alias("s_level"),
        F.col("regionName").alias("s_region"), F.col("defaultCategory").alias("s_category"),
    )
    rows = (
        items.join(last_reply(replies, "link", order).select("link", "reply_text"), "link")
        .join(config, "source_id")
        .withColumn("r", parsed_object(F.col("reply_text"), POLICY_REPLY))
    )
    rows = rows.where(F.col("r").isNotNull() & F.coalesce(F.col("r.isPolicyRelevant"), F.lit(True)))
    r = lambda name: F.col(f"r.{name}")
    none = F.array().cast("array<string>")
    described = F.nullif(F.col("description"), F.lit(""))
    rows = rows.withColumn("title_de", text_or(r("titleDe"), F.col("title")))
    raw_category = text_or(r("category"), F.col("s_category"))
    arrays = [F.coalesce(r("keyChanges"), none), F.coalesce(r("targetGroups"), none)]
    texts = F.array(r("titleZh"), r("titleDe"), r("summaryZh"), r("contentDeSummary"))
    rows = rows.withColumns(
        {
            "_category_text": ingest_text(F.array(raw_category), texts, *arrays),
            "_group_text": ingest_text(texts, *arrays),
        }
    )
    reply_date = F.coalesce(F.nullif(r("publishedAt"), F.lit("")), F.col("published_at"))
    date = F.nullif(normalize_date(reply_date), F.lit(""))
    title_de = F.col("title_de")
    return rows.select(
        feed_slug(F.concat(title_de, F.lit("-"), "link")).alias("slug"),
        text_or(r("titleZh"), title_de).alias("title_zh"),
        title_de,
        text_or(r("publisher"), F.col("s_publisher")).alias("publisher"),
        F.col("link").alias("official_url"),
        F.coalesce(date, F.lit(as_of[:10])).alias("published_at"),
        F.coalesce(normalize_date(r("effectiveAt")), F.lit("")).alias("effective_at"),
        ingest_level(r("regionLevel"), F.col("s_level")).alias("region_level"),
        text_or(r("regionName"), F.col("s_region")).alias("region_name"),
        ingest_category(r("category"), F.col("s_category"), F.col("_category_text")).alias("category"),
        ingest_groups(r("targetGroups"), F.col("_group_text"), F.array(F.lit(C.DEFAULT_GROUP))).alias("target_groups"),
        text_or(r("summaryZh"), F.coalesce(described, title_de)).alias("summary_zh"),
        list_or(r("keyChanges"), F.array(*[F.lit(k) for k in C.DRAFT_KEY_CHANGES])).alias("key_changes"),
        text_or(r("userNotes"), F.lit(C.DRAFT_USER_NOTES)).alias("user_notes"),
        text_or(r("impactZh"), F.lit(C.DRAFT_IMPACT)).alias("impact_zh"),
        text_or(
            r("contentZh"), F.coalesce(F.nullif(r("summaryZh"), F.lit("")), described, title_de)
        ).alias("content_zh"),
        text_or(r("contentDeSummary"), F.coalesce(F.col("description"), F.lit(""))).alias("content_de_summary"),
        normalize_risk(r("riskLevel")).alias("risk_level"),
        normalize_status(F.lit(status)).alias("status"),
    )
