"""Explicit schemas of every role table.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


TEXT, FLAG, COUNT, REAL = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
DAY, TIME, TEXTS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())
NAMED = {
    "string": TEXT, "boolean": FLAG, "int": COUNT, "double": REAL, "date": DAY, "timestamp": TIME, "array<string>": TEXTS,
}


def _schema(columns: str, **nested: T.DataType) -> T.StructType:
    """Nullable columns written as ``name type, ...``; nested types are passed by name."""
    pairs = [c.split() for c in columns.split(",") if c.strip()]
    fields = [T.StructField(name, NAMED[kind]) for name, kind in pairs]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in nested.items()])


POLICY_V1 = _schema(
    "id string, slug string, title_zh string, title_de string, publisher string, official_url string,"
    " published_at date, effective_at date, region_level string, region_name string, category string,"
    " target_groups array<string>, summary_zh string, key_changes array<string>, user_notes string,"
    " impact_zh string, content_zh string, content_de_summary string, risk_level string, status string,"
    " superseded_by string, view_count int, created_at timestamp, updated_at timestamp"
)
POLICY_PAGE = _schema(
    "id string, service_key string, slug string, title_zh string, title_de string, summary_zh string,"
    " requirements_zh array<string>, fees_zh string, duration_zh string, steps_zh array<string>,"
    " region_level string, region_name string, category string, tags array<string>, publisher string,"
    " source_url string, source_name string, translated boolean, translated_at timestamp,"
    " content_hash string, last_fetched_at timestamp, view_count int, created_at timestamp, updated_at timestamp"
)
JOB = _schema(
    "refnr string, title_de string, title_zh string, brief_zh string, employer string, city string,"
    " state_code string, work_type array<string>, is_limited boolean, entry_date date, tags array<string>,"
    " description_de string, description_zh string, source_url string, published_at date, is_active boolean,"
    " translated boolean, translated_at timestamp, synced_at timestamp, created_at timestamp, updated_at timestamp"
)
QUEUE = _schema(
    "id string, source_type string, source_id string, source_url string, priority int, attempts int,"
    " max_attempts int, status string, error_message string, created_at timestamp, processed_at timestamp"
)
REVIEW = _schema(
    "id string, policy_id string, policy_slug string, official_url string, review_status string,"
    " confidence double, findings array<string>, suggested_action string, review_summary string,"
    " reviewed_model string, reviewed_at timestamp, source_fetched_at timestamp, source_hash string, payload string"
)
RUN = _schema(
    "run_id string, mode string, status string, source_id string, source_index int, request_budget int,"
    " request_used int, started_at timestamp, updated_at timestamp, finished_at timestamp,"
    " next_resume_at timestamp, last_error string, checkpoint string",
    totals=_schema("sourcesProcessed int, sourcesSkipped int, sourcesFailed int, policiesUpserted int, itemsSkipped int"),
)
SOURCE = _schema(
    "id string, name string, publisher string, regionLevel string, regionName string, defaultCategory string,"
    " homepageUrl string, feedUrl string, repairHint string, scraper string, note string, enabled boolean,"
    " lastRepairedAt string"
)
PAGE_STATE = _schema("url string, etag string")
FETCH = _schema("url string, status int, etag string, last_modified string, body string, error string")
FEED_ITEM = _schema("source_id string, pos int, title string, link string, description string, published_at string")
MODEL_REPLY = _schema("batch_id string, kind string, round int, reply_text string")
LOG_LINE = _schema("run_id string, line_no int, line string")
JOB_HIT_ITEM = _schema(
    "refnr string, titel string, berufsbezeichnung string, arbeitgeber string,"
    " aktuelleVeroeffentlichungsdatum string, region string, arbeitszeit array<string>",
    arbeitsort=_schema("ort string, stadt string, region string"),
    arbeitsmarktdaten=_schema("refnr string, arbeitszeit array<string>"),
)
JOB_PAGE = T.StructType([T.StructField("stellenangebote", T.ArrayType(JOB_HIT_ITEM))])
SCRAPED_ITEM = _schema("title string, url string, date string, paragraphs array<string>")
ARCHIVE_PAGE = _schema("path string, title string, content string")
POLICY_REPLY = _schema(
    "isPolicyRelevant boolean, titleZh string, titleDe string, publisher string, publishedAt string,"
    " effectiveAt string, regionLevel string, regionName string, category string, targetGroups array<string>,"
    " summaryZh string, keyChanges array<string>, userNotes string, impactZh string, contentZh string,"
    " contentDeSummary string, riskLevel string"
)
REVIEW_REPLY = _schema(
    "reviewStatus string, confidence string, findings array<string>, suggestedAction string, reviewSummary string"
)
