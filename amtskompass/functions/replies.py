"""Reading model replies: fences, JSON shapes, enum and number normalisers, length caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from .text import computed, list_or, text_or, trim_all

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def json_object_text(reply: Column) -> Column:
    """Text from the first brace to the last one, inside the first fenced block if there is one.

    Null when there is no such object.
    """
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(.*?)```", 1)
    raw = F.when(reply.rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(reply)
    start = F.instr(raw, "{")
    tail = F.instr(F.reverse(raw), "}")
    end = F.length(raw) - tail + 1
    return F.when((start > 0) & (tail > 0) & (end > start), F.substring(raw, start, end - start + 1))


def fence_stripped(reply: Column) -> Column:
    """Drop a leading fence line and a closing fence line, then control characters."""
    text = trim_all(reply)
    lines = F.split(text, "\n")
    last = F.element_at(lines, -1)
    body_len = F.when(trim_all(last) == "```", F.size(lines) - 2).otherwise(F.size(lines) - 1)
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(body_len, F.lit(0))), "\n")
    return F.regexp_replace(F.when(text.startswith("```"), body).otherwise(text), CONTROL, "")


def unwrap_text_block(reply: Column) -> Column:
    """JSON nested in the ``text`` field of a content block; other replies unchanged."""
    inner = F.get_json_object(reply, "$.text")
    return F.when(inner.isNotNull() & (F.get_json_object(reply, "$.type") == "text"), inner).otherwise(reply)


def reply_items(df: DataFrame, text: str, item: T.StructType, out: str = "item") -> DataFrame:
    """One row per reply entry, whatever the shape of the (fence-stripped) reply text.

    Accepted shapes: array, object, ``{"results": [...]}`` and JSON lines.  Columns
    ``pos`` (entry order) and ``out`` are added; unreadable replies give no row.
    """
    rows = computed(df, {"_body": F.trim(F.col(text))})
    body = F.col("_body")
    lines = F.filter(F.transform(F.split(body, "\n"), F.trim), lambda x: x.startswith("{"))
    rows = computed(
        rows,
        {
            "_ok": F.try_parse_json(body).isNotNull(),
            "_results": F.when(body.startswith("{"), F.get_json_object(body, "$.results")),
            "_lines": F.when(body.startswith("{"), lines),
        },
    )
    # a parser stops after the first object, so JSON lines are recognised by their first line
    first = F.get("_lines", F.lit(0))
    per_line = body.startswith("{") & first.endswith("}") & F.try_parse_json(first).isNotNull()
    parsed = F.filter("_lines", lambda x: x.endswith("}") & F.try_parse_json(x).isNotNull())
    entries = (
        F.when(F.col("_ok") & body.startswith("["), F.from_json(body, T.ArrayType(item)))
        .when(F.col("_results").startswith("["), F.from_json("_results", T.ArrayType(item)))
        .when(per_line, F.transform(parsed, lambda x: F.from_json(x, item)))
        .when(F.col("_ok") & body.startswith("{"), F.array(F.from_json(body, item)))
    )
    kept = df.columns
    return computed(rows, {"_entries": entries}).select(*kept, F.posexplode("_entries").alias("pos", out))


# --- normalisers --------------------------------------------------------------------


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def normalize_risk(value: Column) -> Column:
    return one_of(value, C.RISK_LEVELS, "medium")


def normalize_status(value: Column) -> Column:
    return one_of(value, C.POLICY_STATUSES, "draft")


def normalize_review_status(value: Column) -> Column:
    return one_of(value, C.REVIEW_STATUSES, "uncertain")


def normalize_action(value: Column) -> Column:
    return one_of(value, C.REVIEW_ACTIONS, "manual_check")


def normalize_confidence(value: Column) -> Column:
    """Leading number of the text, clamped to [0, 1]; 0 when there is none."""
    prefix = F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    number = F.nullif(prefix, F.lit("")).try_cast("double")
    number = F.when(value.rlike(r"^\s*\+?Infinity"), F.lit(1.0)).otherwise(F.coalesce(number, F.lit(0.0)))
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))


# Limits of the stored fields: format of the tables, never used for matching.
TITLE_CHARS, SUMMARY_CHARS, LINE_CHARS, LIST_ITEMS, JOB_TITLE_CHARS, BRIEF_CHARS = 100, 600, 200, 20, 20, 100


def capped(value: Column, length: int, default: str = "") -> Column:
    """Text cut to ``length``; missing or empty text becomes the default first."""
    return F.substring(F.coalesce(F.nullif(value, F.lit("")), F.lit(default)), 1, length)


def policy_enrichment(reply: Column) -> list[Column]:
    """Stored policy fields of a parsed reply struct, with their length caps."""
    empty = F.array().cast("array<string>")
    return [
        capped(reply["title_zh"], TITLE_CHARS).alias("title_zh"),
        capped(reply["summary_zh"], SUMMARY_CHARS).alias("summary_zh"),
        F.slice(F.coalesce(reply["requirements_zh"], empty), 1, LIST_ITEMS).alias("requirements_zh"),
        capped(reply["fees_zh"], LINE_CHARS, C.UNKNOWN_TEXT).alias("fees_zh"),
        capped(reply["duration_zh"], LINE_CHARS, C.UNKNOWN_TEXT).alias("duration_zh"),
        F.slice(F.coalesce(reply["steps_zh"], empty), 1, LIST_ITEMS).alias("steps_zh"),
    ]


def job_enrichment(reply: Column) -> list[Column]:
    """Stored job fields of a parsed reply struct, with their length caps."""
    return [
        capped(reply["title_zh"], JOB_TITLE_CHARS).alias("title_zh"),
        capped(reply["brief_zh"], BRIEF_CHARS).alias("brief_zh"),
    ]


__all__ = [
    "capped", "fence_stripped", "job_enrichment", "json_object_text", "list_or", "normalize_action",
    "normalize_confidence", "normalize_review_status", "normalize_risk", "normalize_status", "one_of",
    "policy_enrichment", "reply_items", "text_or", "unwrap_text_block",
]
