"""Queue, enrichment, activation, run and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import prompts
from ..operators import claims, enrich, jobs, quality, queue, runs
from ..session import shared_folder
from ..sources import adapters as A
from ..sources.commits import append_once, new_folder, publish_json, read_appended, read_published
from ..sources.schemas import QUEUE, REVIEW
from .registry import query
from .roles_sql import any_of, q, with_roles
from .text_plans import parsed_replies

AS_OF = "2024-07-01 00:00:00"
STAMP = "'2024-07-01 00:00:00'"


@query(
    "O6_claim_order",
    with_roles(["queue"], "SELECT id, priority FROM queue WHERE status = 'pending' ORDER BY priority DESC NULLS FIRST, created_at, id LIMIT 5"),
)
def o6(spark, d):
    return queue.next_items(A.queue(spark, d)).select("id", "priority")


@query(
    "Q3_claim",
    with_roles(["queue"], """, top AS (SELECT id FROM queue WHERE status = 'pending' ORDER BY priority DESC NULLS FIRST, created_at, id LIMIT 5)
SELECT id, CASE WHEN id IN (SELECT id FROM top) THEN 'processing' ELSE status END AS status,
  attempts + CASE WHEN id IN (SELECT id FROM top) THEN 1 ELSE 0 END AS attempts FROM queue"""),
)
def q3(spark, d):
    return queue.claim(A.queue(spark, d), 5).select("id", "status", "attempts")


@query(
    "Q3_claims_in_turn",
    with_roles(["queue"], """, ranked AS (SELECT id, row_number() OVER (ORDER BY priority DESC NULLS FIRST, created_at, id) AS rn FROM queue WHERE status = 'pending')
SELECT q.id, CASE WHEN rn <= 5 THEN 'done' WHEN rn <= 12 THEN 'processing' ELSE status END AS status, attempts + CASE WHEN rn <= 12 THEN 1 ELSE 0 END AS attempts,
  CASE WHEN rn <= 5 THEN """ + STAMP + """ END AS processed_at FROM queue q LEFT JOIN ranked USING (id)"""),
)
def q3_in_turn(spark, d):
    """Two workers on one committed queue: the second one's claim is refused once and repeated; the first one reports success."""
    table = claims.QueueTable.create(A.queue(spark, d), new_folder(shared_folder(spark), "queue"))
    late = table.propose_claim(7)
    first = table.claim(5)
    if table.commit(late):
        raise AssertionError("a claim from an old version was accepted")
    table.claim(7)
    table.settle(first.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message")), AS_OF)
    return table.read().select("id", "status", "attempts", "processed_at")


FETCHED = "SELECT CAST(user_id AS VARCHAR) AS refnr FROM events WHERE event_type = 'view' GROUP BY 1"


@query(
    "Q2_enqueue_jobs",
    with_roles(["queue", "jobs"], f""", due AS (SELECT refnr FROM jobs WHERE is_active AND (length(trim(coalesce(description_de, ''))) > 50 OR refnr IN ({FETCHED})))
SELECT source_type, source_id, status, priority, attempts FROM queue WHERE NOT (source_type = 'job' AND source_id IN (SELECT refnr FROM due))
UNION ALL SELECT 'job', refnr, 'pending', 1, 0 FROM due"""),
)
def q2(spark, d):
    viewed = A.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("refnr")).agg(
        F.max(F.when(F.col("event_type") == "view", "Beschreibung")).alias("description")
    )
    out = queue.enqueue_jobs(A.queue(spark, d), A.jobs(spark, d), viewed, AS_OF)
    return out.select("source_type", "source_id", "status", "priority", "attempts")


@query(
    "J8_resolve_queue",
    with_roles(["queue", "policy_pages", "jobs"], """
SELECT q.id, coalesce(p.id IS NOT NULL OR j.refnr IS NOT NULL, false) AS found, md5(coalesce(p.title_de, j.title_de)) AS title_md5,
  CASE WHEN p.id IS NULL AND j.refnr IS NULL THEN CASE q.source_type WHEN 'policy' THEN 'Policy ' ELSE 'Job ' END || q.source_id || ' not found' END AS error
FROM queue q LEFT JOIN policy_pages p ON q.source_type = 'policy' AND p.id = q.source_id LEFT JOIN jobs j ON q.source_type = 'job' AND j.refnr = q.source_id"""),
)
def j8(spark, d):
    out = queue.resolve_queue(A.queue(spark, d), A.policy_pages(spark, d), A.jobs(spark, d))
    return out.select("id", "found", F.md5("title").alias("title_md5"), "error")


@query(
    "Q4_settle",
    with_roles(["queue"], f"""
SELECT id, CASE WHEN status <> 'processing' THEN status WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN 'done' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
  attempts + CASE WHEN status = 'processing' AND CAST(source_id AS BIGINT) % 3 <> 0 THEN 1 ELSE 0 END AS attempts,
  CASE WHEN status = 'processing' AND CAST(source_id AS BIGINT) % 3 <> 0 THEN repeat('e', 500) END AS error_message,
  CASE WHEN status = 'processing' AND (CAST(source_id AS BIGINT) % 3 = 0 OR attempts + 1 >= 3) THEN {STAMP} END AS processed_at FROM queue"""),
)
def q4(spark, d):
    items = A.queue(spark, d)
    ok = F.col("source_id").cast("bigint") % 3 == 0
    outcomes = items.where("status = 'processing'").select("id", ok.alias("ok"), F.lit("e" * 600).alias("message"))
    return queue.settle(items, outcomes, AS_OF).select("id", "status", "attempts", "error_message", "processed_at")


@query(
    "Q7_retry_plan",
    """WITH o AS (SELECT user_id AS batch_id, event_id AS key, event_id % 3 + 1 AS round, event_type = 'view' AND user_id % 2 = 0 AS ok FROM events),
b AS (SELECT batch_id, round, bool_or(ok) AS any_ok FROM o GROUP BY 1, 2),
s AS (SELECT o.*, CASE WHEN ok THEN 'done' WHEN o.round = 1 THEN 'retry_batch' WHEN o.round = 2 AND NOT any_ok THEN 'retry_single' ELSE 'failed' END AS step FROM o JOIN b USING (batch_id, round))
SELECT batch_id, key, round, step, CASE WHEN step LIKE 'retry%' THEN round + 1 END AS next_round, CASE WHEN step = 'retry_batch' THEN 3000 WHEN step = 'retry_single' THEN 1500 END AS text_cap FROM s""",
)
def q7(spark, d):
    outcomes = A.table(spark, d, "events").select(
        F.col("user_id").alias("batch_id"), F.col("event_id").alias("key"), (F.col("event_id") % 3 + 1).alias("round"),
        ((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0)).alias("ok"),
    )
    return queue.retry_plan(outcomes)


LAST = """, entries AS (SELECT * FROM replies WHERE shape IN (0, 1, 2, 3, 5)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY refnr ORDER BY turn DESC) AS rn FROM entries) WHERE rn = 1)"""


@query(
    "J6_reconcile",
    with_roles(["jobs", "replies"], LAST + " SELECT j.refnr, l.refnr IS NOT NULL AS ok, md5(l.text) AS text_md5 FROM jobs j LEFT JOIN last l ON j.refnr = l.refnr"),
)
def j6(spark, d):
    out = enrich.reconcile(A.jobs(spark, d), parsed_replies(spark, d).drop("key"), "refnr", "description_zh", ["turn", "pos"])
    return out.select("refnr", "ok", F.md5("r_description_zh").alias("text_md5"))


ENRICHED = {
    "job_description": "md5(CASE WHEN l.refnr IS NOT NULL THEN l.text ELSE description_zh END) AS a, array_to_string(CASE WHEN l.refnr IS NOT NULL THEN [l.role, 'IT/技术'] ELSE tags END, '|') AS b, l.refnr IS NOT NULL OR translated AS c",
    "job_title": "md5(CASE WHEN l.refnr IS NOT NULL THEN l.title_zh ELSE j.title_zh END) AS a, '' AS b, translated AS c",
    "job_tags": "'' AS a, array_to_string(CASE WHEN l.refnr IS NOT NULL THEN [l.role, 'IT/技术'] ELSE tags END, '|') AS b, translated AS c",
}


def _register_enrichment(kind: str, sql: str) -> None:
    @query(f"Q5_enrich_{kind}", with_roles(["jobs", "replies"], LAST + f" SELECT j.refnr, {sql} FROM jobs j LEFT JOIN last l ON j.refnr = l.refnr"))
    def enriched(spark, d):
        out = enrich.apply_enrichment(A.jobs(spark, d), parsed_replies(spark, d).drop("key"), kind, "refnr", ["turn", "pos"], AS_OF)
        a = {"job_description": F.md5("description_zh"), "job_title": F.md5("title_zh"), "job_tags": F.lit("")}[kind]
        b = F.lit("") if kind == "job_title" else F.array_join("tags", "|")
        return out.select("refnr", a.alias("a"), b.alias("b"), F.col("translated").alias("c"))


for _kind, _sql in ENRICHED.items():
    _register_enrichment(_kind, _sql)


@query(
    "Q5_enrich_policy_guide",
    with_roles(["policy_pages", "replies"], LAST + """ SELECT p.id, CASE WHEN l.refnr IS NOT NULL THEN l.title_zh ELSE p.title_zh END AS title_zh,
  CASE WHEN l.refnr IS NOT NULL THEN '' ELSE fees_zh END AS fees_zh, l.refnr IS NOT NULL OR translated AS translated FROM policy_pages p LEFT JOIN last l ON p.id = l.refnr"""),
)
def q5_guide(spark, d):
    found = parsed_replies(spark, d).drop("key").withColumnRenamed("refnr", "id")
    out = enrich.apply_enrichment(A.policy_pages(spark, d), found, "policy_guide", "id", ["turn", "pos"], AS_OF)
    return out.select("id", "title_zh", "fees_zh", "translated")


ACTIVE = {
    "length": "length(description_de) > 20 AND length(description_zh) > 0 AND length(title_zh) > 0",
    "null_only": "description_de IS NOT NULL AND description_zh IS NOT NULL AND title_zh IS NOT NULL",
}


def _register_activation(mode: str, sql: str) -> None:
    @query(f"Q8_activation_{mode}", with_roles(["jobs"], f"SELECT refnr, coalesce({sql}, false) AS is_active FROM jobs"))
    def activated(spark, d):
        return enrich.activation(A.jobs(spark, d), mode).select("refnr", "is_active")


for _mode, _sql in ACTIVE.items():
    _register_activation(_mode, _sql)


@query(
    "Q8_activation_respect_delisted",
    with_roles(["jobs"], f"SELECT refnr, coalesce({ACTIVE['length']}, false) AND refnr NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events) AS is_active FROM jobs"),
)
def q8_delisted(spark, d):
    gone = A.table(spark, d, "events").select(F.col("user_id").cast("string").alias("refnr"))
    return enrich.activation(A.jobs(spark, d), delisted=gone).select("refnr", "is_active")


RESUME = {"backfill": "2024-01-01 00:00:00", "recent": "2030-01-01 00:00:00", "resume": "2030-01-01 00:00:00"}


def _register_resume(mode: str, as_of: str) -> None:
    sql = f"""
SELECT CASE WHEN w THEN 'stay_paused' WHEN g THEN 'continue' ELSE 'new_run' END AS decision, CASE WHEN w OR g THEN run_id END AS run_id,
  CASE WHEN w OR g THEN source_index ELSE 0 END AS source_index, CASE WHEN w OR g THEN request_used ELSE 0 END AS request_used
FROM (SELECT *, status = 'paused' AND next_resume_at > TIMESTAMP '{as_of}' AS w, status = 'paused' AND NOT (next_resume_at > TIMESTAMP '{as_of}') AND mode = '{mode}' AS g
  FROM runs ORDER BY updated_at DESC, run_id DESC LIMIT 1)"""

    @query(f"Q11_resume_{mode}", with_roles(["runs"], sql))
    def resume(spark, d):
        return runs.resume_point(A.runs(spark, d), mode, as_of)


for _mode, _as_of in RESUME.items():
    _register_resume(_mode, _as_of)


# checkpoints with known keys, a key nobody knows, a known key of another type, and text that is not JSON
CHECKPOINT = """CASE WHEN event_id % 10 = 9 THEN 'not json {' ELSE '{"mode": "recent", "sourceIndex": ' || (user_id % 9) || ', "requestUsed": ' || CASE WHEN event_id % 7 = 0 THEN '"many"' ELSE CAST(event_id % 500 AS VARCHAR) END
  || ', "totals": {"policiesUpserted": ' || (event_id % 40) || ', "odd": [' || event_id || ']}, "x_' || (event_id % 3) || '": {"kept": ' || event_id || '}}' END"""


def checkpoints(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"mode": "recent", "sourceIndex": '), text(u % 9), F.lit(', "requestUsed": '), F.when(i % 7 == 0, '"many"').otherwise(text(i % 500)),
        F.lit(', "totals": {"policiesUpserted": '), text(i % 40), F.lit(', "odd": ['), text(i), F.lit(']}, "x_'), text(i % 3), F.lit('": {"kept": '), text(i), F.lit("}}"),
    )
    rows = A.table(spark, d, "events").select(text(i).alias("run_id"), F.when(i % 10 == 9, "not json {").otherwise(body).alias("checkpoint"))
    return runs.open_checkpoints(rows)


@query(
    "Q11_open_checkpoints",
    f"""WITH c AS (SELECT event_id, user_id, {CHECKPOINT} AS t FROM events), j AS (SELECT *, event_id % 10 < 9 AS ok FROM c)
SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN ok THEN 'recent' END AS mode, CASE WHEN ok THEN user_id % 9 END AS source_index,
  CASE WHEN ok AND event_id % 7 > 0 THEN event_id % 500 END AS request_used, CASE WHEN ok THEN event_id % 40 END AS policies_upserted,
  CASE WHEN ok THEN '{{"mode":"recent","requestUsed":' || json_extract(t, '$.requestUsed') || ',"sourceIndex":' || (user_id % 9) || ',"totals":{{"odd":[' || event_id || '],"policiesUpserted":' || (event_id % 40)
    || '}},"x_' || (event_id % 3) || '":{{"kept":' || event_id || '}}}}' END AS written_back FROM j""",
)
def q11_open(spark, d):
    rows = checkpoints(spark, d)
    known = [F.col(f"cp_{c}").alias(c) for c in ("mode", "source_index", "request_used", "policies_upserted")]
    return rows.select("run_id", *known, runs.checkpoint_json().alias("written_back"))


@query(
    "Q11_checkpoint_keys",
    """SELECT name, type, count(*) AS n FROM (
  SELECT unnest(['mode', 'sourceIndex', 'requestUsed', 'totals', 'x_' || (event_id % 3)]) AS name,
    unnest(['STRING', 'BIGINT', CASE WHEN event_id % 7 = 0 THEN 'STRING' ELSE 'BIGINT' END, 'OBJECT<odd: ARRAY<BIGINT>, policiesUpserted: BIGINT>', 'OBJECT<kept: BIGINT>']) AS type
  FROM events WHERE event_id % 10 < 9) GROUP BY 1, 2""",
)
def q11_keys(spark, d):
    return runs.checkpoint_keys(checkpoints(spark, d)).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "Q11_run_totals",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (event_type <> 'error') AS sources_processed, count(*) FILTER (event_type = 'error') AS sources_skipped,
  count(*) FILTER (event_type = 'click') AS sources_failed, CAST(coalesce(sum(event_id % 5) FILTER (event_type <> 'error'), 0) AS BIGINT) AS policies_upserted,
  CAST(coalesce(sum(event_id % 3) FILTER (event_type <> 'error'), 0) AS BIGINT) AS items_skipped, CAST(coalesce(sum(event_id % 7) FILTER (event_type <> 'error'), 0) AS BIGINT) AS request_used FROM events GROUP BY 1""",
)
def q11_totals(spark, d):
    i = F.col("event_id")
    outcome = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "click", "failed").otherwise("done")
    steps = A.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run_id"), outcome.alias("outcome"), (i % 5).alias("flushed"), (i % 3).alias("skipped"), (i % 7).alias("requests"),
    )
    return runs.run_totals(steps)


def review_replies(spark, d):
    """Reviews written by chat turns: fenced, plain and unreadable replies, and fetch errors."""
    i = F.col("turn")
    body = F.to_json(
        F.struct(
            A.pick(["ok", "needs_update", "strange"], i).alias("reviewStatus"), A.pick(["0.9", "1.7 hoch", "x"], i).alias("confidence"),
            F.array(F.col("text"), F.lit(" ")).alias("findings"), A.pick(["keep", "none"], i).alias("suggestedAction"), F.lit(" ").alias("reviewSummary"),
        )
    )
    return A.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("policy_id"), i.alias("turn"), F.col("text").alias("source_text"),
        F.when(i % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 4 == 3, "kein Objekt").otherwise(body).alias("reply_text"),
        F.when(F.col("role") == "system", "Fetch failed 500").alias("error"),
    )


@query(
    "Q12_review_records",
    with_roles(["policies_v1"], f"""
SELECT id AS policy_id, slug AS policy_slug, CASE WHEN ok THEN CASE turn % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'needs_update' ELSE 'uncertain' END ELSE 'uncertain' END AS review_status,
  CASE WHEN ok THEN CASE turn % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN ok AND turn % 2 = 0 THEN 'keep' ELSE 'manual_check' END AS suggested_action,
  CASE WHEN ok THEN {q(C.REVIEW_DONE_SUMMARY)} ELSE {q(C.REVIEW_FAILED_SUMMARY)} END AS review_summary, CASE WHEN ok THEN sha256(text) END AS source_hash,
  md5(CASE WHEN ok THEN trim(text, ' ' || chr(10)) WHEN role = 'system' THEN 'Fetch failed 500' ELSE 'reply without a readable JSON object' END) AS findings_md5
FROM policies_v1 p JOIN (SELECT *, role <> 'system' AND turn % 4 <> 3 AS ok FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1) c ON p.doc_id = c.conv_id"""),
)
def q12(spark, d):
    out = enrich.review_records(A.policies_v1(spark, d), review_replies(spark, d), ["turn"])
    return out.select(
        "policy_id", "policy_slug", "review_status", "confidence", "suggested_action", "review_summary", "source_hash",
        F.md5(F.array_join("findings", "|")).alias("findings_md5"),
    )


def draft_inputs(spark, d):
    """Feed items from documents, replies about them, and their sources."""
    i = F.col("doc_id")
    docs = A.table(spark, d, "documents")
    link = F.concat(F.lit("https://feed.example/"), i.cast("string"))
    items = docs.select(
        F.col("source").alias("source_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), link.alias("link"),
        F.when(i % 2 == 0, F.col("text")).otherwise("").alias("description"), F.lit("2026-04-21").alias("published_at"),
    )
    body = F.to_json(
        F.struct(
            F.when(i % 7 == 0, False).otherwise(True).alias("isPolicyRelevant"), F.when(i % 3 == 0, F.col("lang")).alias("titleZh"),
            F.when(i % 2 == 0, "22.04.2026").alias("publishedAt"), F.when(i % 3 == 1, "Stadt").alias("regionLevel"),
            F.when(i % 4 == 0, "税务与社保").when(i % 4 == 1, "Hundesteuer").alias("category"), F.when(i % 5 == 0, F.array(F.lit("车主"))).alias("targetGroups"),
            F.when(i % 3 == 2, F.array(F.lit(" a "), F.lit(""))).alias("keyChanges"), F.when(i % 2 == 1, "high").otherwise("huge").alias("riskLevel"),
        )
    )
    replies = docs.select(link.alias("link"), i.alias("seq"), F.when(i % 11 == 0, "nichts").otherwise(F.concat(F.lit("Antwort: "), body)).alias("reply_text"))
    sources = docs.select("source").distinct().select(
        F.col("source").alias("id"), F.concat(F.lit("Amt "), "source").alias("publisher"), F.lit("州").alias("regionLevel"),
        F.col("source").alias("regionName"), F.lit("综合政策").alias("defaultCategory"),
    )
    return items, replies, sources


@query(
    "Q13_drafts_from_replies",
    f"""WITH b AS (SELECT *, string_split(text, chr(10))[1] AS title, 'https://feed.example/' || doc_id AS link FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0),
t AS (SELECT *, trim(title, ' ') AS ttl, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS description, CASE doc_id % 4 WHEN 0 THEN '税务与社保' WHEN 1 THEN 'Hundesteuer' ELSE '综合政策' END AS raw FROM b)
SELECT link AS official_url, md5(CASE WHEN doc_id % 3 = 0 THEN lang ELSE title END) AS title_zh_md5, 'Amt ' || source AS publisher,
  CASE WHEN doc_id % 2 = 0 THEN '2026-04-22' ELSE '2026-04-21' END AS published_at, CASE WHEN doc_id % 3 = 1 THEN '市' ELSE '州' END AS region_level,
  CASE doc_id % 4 WHEN 0 THEN '税务与社保' WHEN 1 THEN '税务与社保' ELSE '其他' END AS category,
  CASE WHEN doc_id % 5 = 0 THEN '车主' ELSE '可能相关' END AS target_groups, CASE WHEN doc_id % 3 = 2 THEN 'a' ELSE {q(C.DRAFT_KEY_CHANGES[0])} END AS key_changes,
  md5(CASE WHEN description <> '' THEN description ELSE title END) AS summary_md5, CASE WHEN doc_id % 2 = 1 THEN 'high' ELSE 'medium' END AS risk_level, 'draft' AS status FROM t""",
)
def q13(spark, d):
    items, found, sources = draft_inputs(spark, d)
    out = enrich.drafts_from_replies(items, found, sources, AS_OF, ["seq"])
    return out.select(
        "official_url", F.md5("title_zh").alias("title_zh_md5"), "publisher", "published_at", "region_level", "category", "target_groups",
        "key_changes", F.md5("summary_zh").alias("summary_md5"), "risk_level", "status",
    )


@query(
    "R1_validate_policies",
    with_roles(["policies_v1"], """
SELECT id, array_to_string(list_filter([
  CASE WHEN length(title_zh) < 2 THEN 'title_zh' END, CASE WHEN length(title_de) < 2 THEN 'title_de' END, CASE WHEN length(publisher) < 2 THEN 'publisher' END,
  CASE WHEN published_at IS NULL THEN 'published_at' END, CASE WHEN length(region_name) < 1 THEN 'region_name' END, CASE WHEN length(category) < 1 THEN 'category' END,
  CASE WHEN length(summary_zh) < 5 THEN 'summary_zh' END, CASE WHEN length(user_notes) < 5 THEN 'user_notes' END, CASE WHEN length(impact_zh) < 5 THEN 'impact_zh' END,
  CASE WHEN length(content_zh) < 10 THEN 'content_zh' END, CASE WHEN NOT regexp_matches(official_url, '^https?://[^\\s/]+') THEN 'official_url' END,
  CASE WHEN region_level NOT IN ('联邦', '州', '市', 'Landkreis') THEN 'region_level' END], lambda x: x IS NOT NULL), '|') AS issues FROM policies_v1"""),
)
def r1(spark, d):
    return quality.validate_policies(A.policies_v1(spark, d)).select("id", "issues")


@query(
    "R2_audit_reviews",
    with_roles(["reviews"], f"""
SELECT 'status_enum' AS rule, count(*) FILTER (review_status NOT IN ({', '.join(q(s) for s in C.REVIEW_STATUSES)})) AS violations FROM reviews
UNION ALL SELECT 'action_enum', count(*) FILTER (suggested_action NOT IN ({', '.join(q(s) for s in C.REVIEW_ACTIONS)})) FROM reviews
UNION ALL SELECT 'confidence_range', count(*) FILTER (confidence < 0 OR confidence > 1) FROM reviews
UNION ALL SELECT 'id_unique', 0 FROM (SELECT count(*) FROM reviews)"""),
)
def r2(spark, d):
    return quality.audit(A.reviews(spark, d), "review")


@query(
    "R2_audit_policies",
    with_roles(["policies_v1"], """
SELECT 'slug_null' AS rule, 0 AS violations FROM (SELECT count(*) FROM policies_v1) UNION ALL SELECT 'status_enum', 0 UNION ALL SELECT 'risk_enum', 0
UNION ALL SELECT 'level_enum', count(*) FILTER (region_level = 'bogus') FROM policies_v1
UNION ALL SELECT 'slug_unique', (SELECT count(*) FROM (SELECT title_de FROM policies_v1 GROUP BY 1 HAVING count(*) > 1))"""),
)
def r2_policies(spark, d):
    doubled = A.policies_v1(spark, d).withColumn("slug", F.col("title_de"))
    return quality.audit(doubled, "policy_v1")




# --- details, prompt blocks and audits of the other tables ----------------------------------


@query(
    "Q10_apply_details",
    with_roles(["jobs"], f"""
SELECT refnr, CASE WHEN hit THEN detail ELSE description_de END AS description_de,
  CASE WHEN NOT hit THEN array_to_string(work_type, '|') WHEN len(w) = 0 THEN '全职' ELSE array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') END AS work_type,
  CASE WHEN hit THEN {STAMP} ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM (SELECT *, ok % 4 > 1 AS hit, list_filter([CASE WHEN ok % 3 = 0 THEN '迷你岗' END, CASE WHEN ok % 5 = 0 THEN '兼职' END, CASE WHEN contains(t, 'vollzeit') THEN '全职' END,
    CASE WHEN contains(t, 'teilzeit') THEN '兼职' END, CASE WHEN {any_of('t', C.REMOTE_NEEDLES)} THEN '远程' END], lambda x: x IS NOT NULL) AS w
  FROM (SELECT *, lower(detail || ' ' || title_de) AS t FROM (SELECT *, 'Detail ' || title_de || ' ' || ok AS detail FROM jobs)))"""),
)
def q10_details(spark, d):
    """Fetched job details folded in: a third of the fetches failed or is of an unknown job."""
    jobs_ = A.jobs(spark, d)
    n = F.col("refnr").cast("bigint")
    text = F.concat(F.lit("Detail "), "title_de", F.lit(" "), "refnr")
    details = jobs_.where(n % 4 > 0).select(
        "refnr", F.col("title_de").alias("stellenangebotsTitel"), F.when(n % 4 > 1, text).alias("stellenangebotsBeschreibung"),
        (n % 3 == 0).alias("istGeringfuegigeBeschaeftigung"), (n % 5 == 0).alias("arbeitszeitTeilzeitVormittag"),
        F.lit(None).cast("boolean").alias("arbeitszeitTeilzeitNachmittag"),
    )
    unknown = details.where(n % 4 == 2).withColumn("refnr", F.concat(F.lit("x"), "refnr"))
    done = jobs.apply_details(jobs_, details.unionByName(unknown), AS_OF)
    return done.select("refnr", "description_de", F.array_join("work_type", "|").alias("work_type"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(
    "X24_title_and_tag_blocks",
    with_roles(["jobs"], """
SELECT refnr, '===JOB 7===' || chr(10) || 'refnr: ' || refnr || chr(10) || '标题: ' || title_de AS title_block,
  '===JOB 7===' || chr(10) || 'refnr: ' || refnr || chr(10) || '职位: ' || substr(title_de, 1, 100) || chr(10) || '描述: ' || substr(coalesce(nullif(description_zh, ''), description_de, ''), 1, 2000) AS tag_block FROM jobs"""),
)
def x24_blocks(spark, d):
    rows = A.jobs(spark, d).withColumn("slot", F.lit(7))
    return rows.select("refnr", prompts.title_block().alias("title_block"), prompts.tag_block().alias("tag_block"))


@query(
    "R2_audit_jobs",
    with_roles(["jobs"], """
SELECT 'refnr_null' AS rule, count(*) FILTER (ok % 10 = 3) AS violations FROM jobs UNION ALL SELECT 'title_null', count(*) FILTER (ok % 7 = 1) FROM jobs
UNION ALL SELECT 'refnr_unique', count(*) FROM (SELECT ok // 2 FROM jobs WHERE ok % 10 <> 3 GROUP BY 1 HAVING count(*) > 1)"""),
)
def r2_jobs(spark, d):
    n = F.col("refnr").cast("bigint")
    broken = A.jobs(spark, d).withColumns({"title_de": F.when(n % 7 != 1, F.col("title_de")), "refnr": F.when(n % 10 != 3, F.floor(n / 2).cast("string"))})
    return quality.audit(broken, "job")


@query(
    "R2_audit_queue",
    with_roles(["queue"], """
SELECT 'type_enum' AS rule, count(*) FILTER (CAST(id AS BIGINT) % 9 = 0) AS violations FROM queue UNION ALL SELECT 'status_enum', count(*) FILTER (CAST(id AS BIGINT) % 8 = 0) FROM queue
UNION ALL SELECT 'source_null', count(*) FILTER (CAST(id AS BIGINT) % 6 = 0) FROM queue UNION ALL SELECT 'id_unique', 0"""),
)
def r2_queue(spark, d):
    n = F.col("id").cast("bigint")
    broken = {
        "source_type": F.when(n % 9 != 0, F.col("source_type")).otherwise("page"), "status": F.when(n % 8 != 0, F.col("status")).otherwise("lost"),
        "source_id": F.when(n % 6 != 0, F.col("source_id")),
    }
    return quality.audit(A.queue(spark, d).withColumns(broken), "queue")


@query(
    "R2_audit_runs",
    with_roles(["runs"], f"""
SELECT 'mode_enum' AS rule, count(*) FILTER (mode NOT IN ({', '.join(q(m) for m in C.RUN_MODES)})) AS violations FROM runs
UNION ALL SELECT 'status_enum', count(*) FILTER (status NOT IN ({', '.join(q(m) for m in C.RUN_STATUSES)})) FROM runs UNION ALL SELECT 'run_id_unique', 0"""),
)
def r2_runs(spark, d):
    return quality.audit(A.runs(spark, d), "run")


@query(
    "R2_audit_pages",
    with_roles(["policy_pages"], """
SELECT 'title_null' AS rule, count(*) FILTER (title_de IS NULL) AS violations FROM policy_pages UNION ALL SELECT 'summary_null', count(*) FILTER (summary_zh IS NULL) FROM policy_pages
UNION ALL SELECT 'level_enum', count(*) FILTER (region_level = 'bogus') FROM policy_pages UNION ALL SELECT 'service_key_unique', 0 UNION ALL SELECT 'slug_unique', 0"""),
)
def r2_pages(spark, d):
    return quality.audit(A.policy_pages(spark, d), "policy")


@query(
    "R2_audit_references",
    with_roles(["reviews", "policy_pages"], """, bad AS (SELECT * FROM reviews WHERE policy_id IS NOT NULL AND policy_id NOT IN (SELECT id FROM policy_pages))
SELECT 'policy_id_in_policy' AS rule, count(*) AS violations, coalesce((SELECT string_agg(id, '|' ORDER BY id) FROM (SELECT id FROM bad ORDER BY id LIMIT 5)), '') AS samples FROM bad"""),
)
def r2_references(spark, d):
    return quality.audit_references(A.reviews(spark, d), A.policy_pages(spark, d).select("id"))


@query(
    "R2_dangling_reviews",
    with_roles(["reviews", "policy_pages"], """
SELECT policy_id AS target, count(*) AS violations FROM reviews WHERE policy_id IS NOT NULL AND CAST(policy_id AS BIGINT) % 2 = 1 OR policy_id NOT IN (SELECT id FROM policy_pages) GROUP BY 1"""),
)
def r2_dangling(spark, d):
    """Every second page is gone."""
    left = A.policy_pages(spark, d).where(F.col("id").cast("bigint") % 2 == 0)
    return quality.reference_summary(A.reviews(spark, d), left.select("id"))


# --- sinks: written below the shared folder and read back --------------------------------------


@query(
    "S7_publish_json",
    with_roles(["reviews"], "SELECT id, policy_id, review_status, confidence, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at FROM reviews WHERE review_status <> 'ok'"),
)
def s7(spark, d):
    """A result is published twice; readers see the second one only."""
    root = new_folder(shared_folder(spark), "results")
    columns = ["id", "policy_id", "review_status", "confidence", "reviewed_at"]
    rows = A.reviews(spark, d).select(*columns)
    publish_json(rows, root)
    publish_json(rows.where("review_status <> 'ok'"), root)
    return read_published(spark, root, type(REVIEW)([f for f in REVIEW if f.name in columns])).select(*columns)


@query(
    "S9_append_once",
    with_roles(["queue"], "SELECT id, source_type, source_id, priority, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM queue"),
)
def s9(spark, d):
    """Two halves are appended, the first one again under its token as a repeated job would."""
    root = new_folder(shared_folder(spark), "appended")
    rows = A.queue(spark, d)
    even = F.col("id").cast("bigint") % 2 == 0
    for token, part in (("even", rows.where(even)), ("odd", rows.where(~even)), ("even", rows.where(even))):
        append_once(part, root, token)
    return read_appended(spark, root, QUEUE).select("id", "source_type", "source_id", "priority", "status", "created_at")
