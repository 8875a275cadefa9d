"""Source, merge, dedupe, ranking and job-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import feeds, jobs as job_ops, merge, ranking, stats
from ..sources import adapters as A
from ..sources.job_api import explode_job_pages, normalize_jobs
from ..sources.registry import active_sources
from ..sources.scraped import ArchiveConfig, RegionConfig, drafts_from_scrape, load_archive_pages
from .registry import query
from .roles_sql import q as sql_q
from .roles_sql import with_roles

AS_OF = "2024-07-01 00:00:00"
STAMP = "'2024-07-01 00:00:00'"


def registry(spark, d):
    """Source registry derived from the suppliers: some disabled, some without feed or homepage."""
    i = F.col("s_suppkey")
    key = i.cast("string")
    return A.table(spark, d, "supplier").select(
        F.concat(F.lit("src"), key).alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Amt "), key).alias("publisher"),
        F.lit("州").alias("regionLevel"),
        F.concat(F.lit("Region "), (i % 5).cast("string")).alias("regionName"),
        F.lit("生活行政").alias("defaultCategory"),
        F.when(i % 7 != 0, F.concat(F.lit("https://host"), (i % 40).cast("string"), F.lit(".example/start"))).alias("homepageUrl"),
        F.when(i % 3 != 0, F.concat(F.lit("https://feeds.example/"), key)).when(i % 2 == 0, "").alias("feedUrl"),
        F.when(i % 4 != 0, i % 4 != 1).alias("enabled"),
    )


REG = """SELECT 'src' || s_suppkey AS id, s_name AS name, 'Amt ' || s_suppkey AS publisher, '州' AS regionLevel, 'Region ' || (s_suppkey % 5) AS regionName,
  CASE WHEN s_suppkey % 7 <> 0 THEN 'https://host' || (s_suppkey % 40) || '.example/start' END AS homepageUrl,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'https://feeds.example/' || s_suppkey WHEN s_suppkey % 2 = 0 THEN '' END AS feedUrl,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 4 <> 1 END AS enabled, s_suppkey FROM supplier"""


@query(
    "S3_active_sources",
    f"SELECT id, feedUrl FROM ({REG}) WHERE coalesce(enabled, true) AND coalesce(feedUrl, '') <> '' AND (contains(lower(regionName), 'region 2') OR contains(lower(id), 'region 2') OR contains(lower(name), 'region 2') OR contains(lower(publisher), 'region 2'))",
)
def s3(spark, d):
    return active_sources(registry(spark, d), "REGION 2").select("id", "feedUrl")


@query(
    "S4_explode_job_pages",
    with_roles(["hits"], "SELECT keyword, kw_ord, page, pos, employer FROM hits"),
)
def s4(spark, d):
    return explode_job_pages(A.job_pages(spark, d)).select(
        "keyword", "kw_ord", "page", "pos", F.col("item.arbeitgeber").alias("employer")
    )


@query(
    "Q9_normalize_jobs",
    with_roles(["hits"], """
SELECT page, pos, refnr, title_de, employer, city, state_code, array_to_string(work_type, '|') AS work_type,
  'https://www.arbeitsagentur.de/jobsuche/jobangebot/' || refnr AS source_url, strftime(published_at, '%Y-%m-%d') AS published_at,
  true AS is_active, false AS translated FROM hits"""),
)
def q9(spark, d):
    return normalize_jobs(explode_job_pages(A.job_pages(spark, d)), AS_OF).select(
        "page", "pos", "refnr", "title_de", "employer", "city", "state_code", "work_type", "source_url", "published_at",
        "is_active", "translated",
    )


FIRST_HIT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY refnr ORDER BY kw_ord, page, pos) AS rn FROM hits) WHERE rn = 1"


@query(
    "U1_merge_job_hits",
    with_roles(["hits"], f"""
SELECT f.refnr, f.title_de, f.employer, k.keywords FROM ({FIRST_HIT}) f
JOIN (SELECT refnr, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM hits GROUP BY refnr) k USING (refnr)"""),
)
def u1(spark, d):
    hits = normalize_jobs(explode_job_pages(A.job_pages(spark, d)), AS_OF)
    return job_ops.merge_job_hits(hits).select("refnr", "title_de", "employer", "keywords")


@query(
    "A7_collect_keywords",
    with_roles(["hits"], "SELECT refnr, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM hits GROUP BY refnr"),
)
def a7(spark, d):
    from ..sources.job_api import hit_refnr

    hits = explode_job_pages(A.job_pages(spark, d)).withColumn("refnr", hit_refnr(F.col("item")))
    return stats.collect_keywords(hits)


@query(
    "W5_first_by",
    with_roles(["hits"], f"SELECT refnr, page, pos, employer FROM ({FIRST_HIT})"),
)
def w5(spark, d):
    hits = normalize_jobs(explode_job_pages(A.job_pages(spark, d)), AS_OF)
    return ranking.first_by(hits, ["refnr"], [F.col("kw_ord"), F.col("page"), F.col("pos")]).select("refnr", "page", "pos", "employer")


# merged order keys and part keys overlap, so the synchronisation sees new, known and missing jobs
SYNC = with_roles(["jobs", "hits"], f"""
SELECT coalesce(j.refnr, f.refnr) AS refnr, coalesce(f.title_de, j.title_de) AS title_de,
  coalesce(f.state_code, j.state_code) AS state_code,
  CASE WHEN f.refnr IS NOT NULL THEN '' ELSE array_to_string(j.tags, '|') END AS tags,
  j.description_de, CASE WHEN f.refnr IS NOT NULL THEN true ELSE false END AS is_active,
  CASE WHEN f.refnr IS NOT NULL THEN false ELSE j.translated END AS translated,
  CASE WHEN f.refnr IS NOT NULL OR j.is_active THEN {STAMP} ELSE strftime(j.updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM jobs j FULL JOIN ({FIRST_HIT}) f ON j.refnr = f.refnr""")


@query("Q10_sync_jobs", SYNC)
def q10(spark, d):
    out = job_ops.sync_jobs(A.jobs(spark, d), explode_job_pages(A.job_pages(spark, d)), AS_OF)
    return out.select("refnr", "title_de", "state_code", "tags", "description_de", "is_active", "translated", "updated_at")


@query(
    "Q10_sync_counts",
    with_roles(["jobs", "hits"], """
SELECT count(DISTINCT h.refnr) AS fetched, count(DISTINCT h.refnr) AS upserted,
  (SELECT count(*) FROM jobs WHERE is_active AND refnr NOT IN (SELECT refnr FROM hits)) AS deactivated FROM hits h"""),
)
def q10_counts(spark, d):
    return job_ops.sync_counts(A.jobs(spark, d), explode_job_pages(A.job_pages(spark, d)))


def fetched_jobs(spark, d):
    return normalize_jobs(job_ops.first_hits(explode_job_pages(A.job_pages(spark, d))), AS_OF)


@query(
    "J1_upsert",
    with_roles(["jobs", "hits"], f"""
SELECT coalesce(j.refnr, f.refnr) AS refnr, coalesce(f.title_de, j.title_de) AS title_de, j.title_zh,
  CASE WHEN j.refnr IS NULL THEN '' ELSE array_to_string(j.tags, '|') END AS tags,
  CASE WHEN f.refnr IS NOT NULL THEN {STAMP} ELSE strftime(j.updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM jobs j FULL JOIN ({FIRST_HIT}) f ON j.refnr = f.refnr"""),
)
def j1(spark, d):
    out = merge.upsert(A.jobs(spark, d), fetched_jobs(spark, d), "refnr", AS_OF, preserve=("tags",), unique=True)
    return out.select("refnr", "title_de", "title_zh", "tags", "updated_at")


def updates_v1(spark, d):
    """Incoming policy rows built from the documents: half keep their stored address."""
    i = F.col("doc_id")
    address = F.when(i % 2 == 0, i).otherwise(i + 1000000000)
    return A.table(spark, d, "documents").select(
        F.concat(F.lit("new-"), i.cast("string")).alias("slug"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), address.cast("string")).alias("official_url"),
        i.alias("pos"), "lang",
    )


UPDATES = """SELECT 'new-' || doc_id AS slug, 'https://' || source || '.example/' || CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS official_url,
  doc_id AS pos, lang FROM documents"""


@query(
    "J2_reuse_slugs",
    with_roles(["policies_v1"], f"SELECT u.pos, coalesce(t.slug, u.slug) AS slug FROM ({UPDATES}) u LEFT JOIN policies_v1 t USING (official_url)"),
)
def j2(spark, d):
    return merge.reuse_slugs(updates_v1(spark, d), A.policies_v1(spark, d)).select("pos", "slug")


@query(
    "J3_exclude_existing",
    with_roles(["policies_v1"], f"SELECT pos, slug FROM ({UPDATES}) WHERE official_url NOT IN (SELECT official_url FROM policies_v1)"),
)
def j3(spark, d):
    return merge.exclude_existing(updates_v1(spark, d), A.policies_v1(spark, d), "official_url").select("pos", "slug")


@query(
    "J5_delist_missing",
    with_roles(["jobs"], f"""
SELECT refnr, is_active AND refnr IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem) AS is_active,
  CASE WHEN is_active AND refnr NOT IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem) THEN {STAMP} ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM jobs"""),
)
def j5(spark, d):
    fetched = A.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("refnr"))
    return merge.delist_missing(A.jobs(spark, d), fetched, AS_OF, min_fetched=1).select("refnr", "is_active", "updated_at")


@query(
    "U3_active_not_fetched",
    with_roles(["jobs"], "SELECT refnr FROM jobs WHERE is_active EXCEPT SELECT CAST(l_partkey AS VARCHAR) FROM lineitem"),
)
def u3(spark, d):
    fetched = A.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("refnr"))
    return merge.delisted_keys(A.jobs(spark, d), fetched)


@query(
    "J7_bulk_status",
    with_roles(["policies_v1"], "SELECT id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'unpublished' ELSE status END AS status FROM policies_v1"),
)
def j7(spark, d):
    keys = A.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return merge.set_status_where(A.policies_v1(spark, d), keys, "unpublished").select("id", "status")


BULK_IDS = [str(i) for i in range(3, 900, 7)]


@query(
    "J7_bulk_status_request",
    with_roles(["policies_v1"], f"""
SELECT id, 'published' AS status, count(*) OVER () AS changed FROM policies_v1 WHERE id IN ({', '.join(sql_q(i) for i in BULK_IDS)})"""),
)
def j7_request(spark, d):
    """The rows of one request with their new status, and how many they are."""
    changed = merge.bulk_status(A.policies_v1(spark, d), [*BULK_IDS, "", "unknown"], "published").select("id", "status")
    return merge.with_count(changed, "changed")


@query("J11_fallback_candidates", f"""
SELECT id, pos, regexp_extract(homepageUrl, '^(https?://[^/?#]+)', 1) || suffix AS candidate FROM ({REG}),
  (SELECT unnest({C.FEED_PATH_SUFFIXES}) AS suffix, unnest(range({len(C.FEED_PATH_SUFFIXES)})) AS pos) WHERE homepageUrl IS NOT NULL""")
def j11(spark, d):
    return feeds.fallback_candidates(registry(spark, d))


def repair_fetches(spark, d):
    """Answers of feeds, homepages and candidate addresses, derived from the suppliers."""
    i = F.col("s_suppkey")
    host = F.concat(F.lit("https://host"), (i % 40).cast("string"), F.lit(".example"))
    s = A.table(spark, d, "supplier")
    feed = s.select(
        F.concat(F.lit("https://feeds.example/"), i.cast("string")).alias("url"),
        F.when(i % 5 == 0, 404).otherwise(200).alias("status"),
        F.when(i % 5 == 1, "<html></html>").when(i % 5 == 2, "<rss></rss>").otherwise("<rss><item></item><item></item></rss>").alias("body"),
    )
    home = s.groupBy(F.concat(host, F.lit("/start")).alias("url"), (i % 40).alias("h")).agg(F.lit(200).alias("status")).select(
        "url", "status",
        F.when(F.col("h") % 2 == 0, '<a href="/x/feed.xml">Feed</a> <a href="/x/feed.xml">again</a>').otherwise("<p>nothing</p>").alias("body"),
    )
    found = s.groupBy(host.alias("host"), (i % 40).alias("h")).agg(F.lit(200).alias("status")).select(
        F.when(F.col("h") % 4 == 0, F.concat("host", F.lit("/x/feed.xml"))).otherwise(F.concat("host", F.lit("/atom.xml"))).alias("url"),
        "status", F.when(F.col("h") % 3 == 0, "<feed></feed>").otherwise("<feed><entry></entry></feed>").alias("body"),
    )
    return feed.unionByName(home).unionByName(found).withColumn("error", F.lit(None).cast("string"))


REPAIR = f"""reg AS (SELECT *, s_suppkey % 40 AS h FROM ({REG})),
verdict AS (SELECT id, feedUrl, h, homepageUrl,
    feedUrl LIKE 'https://%' AND s_suppkey % 5 IN (3, 4) AS ok,
    homepageUrl IS NOT NULL AND h % 3 <> 0 AND (h % 4 = 0 OR h % 4 <> 0) AS repairable, s_suppkey FROM reg),
report AS (SELECT id, CASE WHEN coalesce(ok, false) THEN 'ok' WHEN repairable THEN 'repair_found' ELSE 'needs_manual_check' END AS status,
    coalesce(feedUrl, '') AS current_feed_url,
    CASE WHEN NOT coalesce(ok, false) AND repairable THEN CASE WHEN h % 4 = 0 THEN 'https://host' || h || '.example/x/feed.xml' ELSE 'https://host' || h || '.example/atom.xml' END ELSE '' END AS suggested_feed_url,
    CASE WHEN coalesce(ok, false) THEN 2 WHEN repairable THEN 1 ELSE 0 END AS item_count,
    CASE WHEN coalesce(ok, false) OR repairable THEN '' WHEN coalesce(feedUrl, '') = '' THEN 'Missing feedUrl.'
      WHEN s_suppkey % 5 = 0 THEN 'Fetch failed 404 for ' || feedUrl WHEN s_suppkey % 5 = 1 THEN 'URL did not return RSS/Atom content.'
      ELSE 'Feed had no items.' END AS error,
    CASE WHEN coalesce(ok, false) OR homepageUrl IS NULL THEN 0
      WHEN repairable THEN CASE WHEN h % 4 = 0 THEN 1 ELSE 4 + CASE WHEN h % 2 = 0 THEN 1 ELSE 0 END END
      ELSE 10 + CASE WHEN h % 2 = 0 THEN 1 ELSE 0 END END AS checked FROM verdict)"""


@query("H11_repair_report", f"WITH {REPAIR} SELECT id AS source_id, status, current_feed_url, suggested_feed_url, item_count, error, checked FROM report")
def h11(spark, d):
    return feeds.repair_report(registry(spark, d), repair_fetches(spark, d))


@query(
    "J12_apply_repairs",
    f"WITH {REPAIR} SELECT r.id, CASE WHEN p.status = 'repair_found' THEN p.suggested_feed_url ELSE r.feedUrl END AS feedUrl, CASE WHEN p.status = 'repair_found' THEN true ELSE r.enabled END AS enabled, CASE WHEN p.status = 'repair_found' THEN {STAMP} END AS lastRepairedAt FROM reg r JOIN report p USING (id)",
)
def j12(spark, d):
    r = registry(spark, d)
    return feeds.apply_repairs(r, feeds.repair_report(r, repair_fetches(spark, d)), AS_OF).select("id", "feedUrl", "enabled", "lastRepairedAt")


@query(
    "W6_pick_repair",
    f"WITH {REPAIR} SELECT id, CASE WHEN h % 4 = 0 THEN 'https://host' || h || '.example/x/feed.xml' ELSE 'https://host' || h || '.example/atom.xml' END AS suggested_feed_url, 1 AS item_count FROM verdict WHERE repairable",
)
def w6(spark, d):
    fetches = repair_fetches(spark, d)
    health = feeds.feed_health(fetches).select(F.col("url").alias("candidate"), "ok", "item_count")
    return feeds.pick_repair(feeds.repair_candidates(registry(spark, d), fetches).join(health, "candidate"))


@query(
    "U4_unique_candidates",
    f"SELECT id, 10 + CASE WHEN s_suppkey % 40 % 2 = 0 THEN 1 ELSE 0 END AS n FROM ({REG}) WHERE homepageUrl IS NOT NULL",
)
def u4(spark, d):
    return feeds.repair_candidates(registry(spark, d), repair_fetches(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J13_defer_activate",
    with_roles(["jobs", "hits"], f"SELECT f.refnr, coalesce(j.is_active, false) AS is_active FROM ({FIRST_HIT}) f LEFT JOIN jobs j ON j.refnr = f.refnr"),
)
def j13(spark, d):
    return merge.defer_activate(fetched_jobs(spark, d), A.jobs(spark, d)).select("refnr", "is_active")


@query(
    "U2_dedupe_updates",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1",
)
def u2(spark, d):
    docs = A.table(spark, d, "documents").withColumn("official_url", F.concat_ws("/", "source", "lang"))
    return merge.dedupe_first(docs, "official_url", [F.col("n_chars").desc(), F.col("doc_id")]).select("source", "doc_id")


@query(
    "U5_array_dedupe",
    with_roles(["jobs"], "SELECT refnr, array_to_string(list_filter(list_concat(work_type, coalesce(tags, []), work_type), lambda x, i: list_position(list_concat(work_type, coalesce(tags, []), work_type), x) = i), '|') AS merged FROM jobs"),
)
def u5(spark, d):
    from ..functions.labels import merge_tags

    return A.jobs(spark, d).select("refnr", merge_tags(F.col("work_type"), F.col("tags"), F.col("work_type")).alias("merged"))


@query(
    "R3_mutate",
    with_roles(["policies_v1"], f"""
SELECT id, CASE WHEN doc_id % 4 = 2 THEN 'changed' ELSE title_zh END AS title_zh,
  CASE WHEN doc_id % 4 = 2 THEN {STAMP} ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM policies_v1 WHERE doc_id % 4 <> 3
UNION ALL SELECT 'n' || doc_id, 'changed', {STAMP} FROM documents WHERE doc_id % 4 = 1"""),
)
def r3(spark, d):
    i = F.col("doc_id")
    changes = A.table(spark, d, "documents").select(
        F.when(i % 4 == 1, F.concat(F.lit("n"), i.cast("string"))).otherwise(i.cast("string")).alias("id"),
        F.lit("changed").alias("title_zh"),
        F.when(i % 4 == 1, "insert").when(i % 4 == 2, "update").when(i % 4 == 3, "delete").otherwise("insert").alias("change"),
    )
    return merge.mutate(A.policies_v1(spark, d), changes, AS_OF).select("id", "title_zh", "updated_at")


@query(
    "W3_latest_review",
    with_roles(["reviews"], "SELECT policy_id, review_status FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY reviewed_at DESC, id) AS rn FROM reviews) WHERE rn = 1"),
)
def w3(spark, d):
    return stats.latest_review(A.reviews(spark, d)).select("policy_id", "review_status")


@query(
    "A11_review_summary",
    with_roles(["reviews"], "SELECT review_status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY reviewed_at DESC, id) AS rn FROM reviews) WHERE rn = 1 GROUP BY 1"),
)
def a11(spark, d):
    return stats.review_summary(A.reviews(spark, d))


@query(
    "A11_review_progress",
    with_roles(["reviews"], """
SELECT policy_id AS batch_id, count(*) FILTER (review_status = 'ok') AS completed, count(*) FILTER (review_status <> 'ok') AS failed,
  count(*) || '/' || count(*) AS progress FROM reviews GROUP BY 1"""),
)
def a11_progress(spark, d):
    outcomes = A.reviews(spark, d).select(F.col("policy_id").alias("batch_id"), (F.col("review_status") == "ok").alias("ok"))
    return stats.review_progress(outcomes)


@query(
    "W4_budget_admission",
    with_roles(["budget"], """
SELECT source_idx, pos, used_before, used_before < 5600 AS admitted FROM (
  SELECT *, CAST(sum(cost) OVER (ORDER BY source_idx, pos) - cost AS BIGINT) AS used_before FROM budget)"""),
)
def w4(spark, d):
    out = ranking.admit_by_budget(A.budget_items(spark, d), 5600)
    return out.select("source_idx", "pos", "used_before", "admitted")


@query(
    "W4_budget_summary",
    with_roles(["budget"], """
SELECT count(*) FILTER (b < 560) AS admitted, CAST(sum(cost) FILTER (b < 560) AS BIGINT) AS request_used, min(source_idx) FILTER (b >= 560) AS resume_source
FROM (SELECT *, sum(cost) OVER (ORDER BY source_idx, pos) - cost AS b FROM budget)"""),
)
def w4_summary(spark, d):
    return ranking.budget_summary(ranking.admit_by_budget(A.budget_items(spark, d), 560))


@query(
    "Q6_make_batches",
    with_roles(["jobs"], """
SELECT (rn - 1) // 5 AS batch, count(*) AS rows, md5(string_agg('===JOB ' || ((rn - 1) % 5 + 1) || '===' || chr(10) || 'refnr: ' || refnr || chr(10) || '描述:' || chr(10) || substr(coalesce(description_de, ''), 1, 3000), chr(10) || chr(10) ORDER BY rn)) AS prompt_md5
FROM (SELECT *, row_number() OVER (ORDER BY refnr) AS rn FROM jobs WHERE length(description_de) > 20 AND coalesce(description_zh, '') = '') GROUP BY 1"""),
)
def q6(spark, d):
    from ..functions.prompts import description_block

    todo = A.jobs(spark, d).where((F.length("description_de") > 20) & (F.coalesce("description_zh", F.lit("")) == ""))
    out = ranking.make_batches(todo.select("refnr", "description_de"), [F.col("refnr")], 5, description_block(), key=["refnr"])
    return out.select("batch", "rows", F.md5("prompt").alias("prompt_md5"))


@query(
    "X24_prompt_blocks",
    with_roles(["policy_pages"], """
SELECT service_key, md5('===JOB 1===' || chr(10) || 'service_key: ' || service_key || chr(10) || 'source_name: ' || source_name || chr(10) || 'source_url: ' || source_url || chr(10) || 'title_de: ' || title_de || chr(10) || 'content:' || chr(10) || substr(CASE WHEN coalesce(summary_zh, '') <> '' THEN summary_zh ELSE title_de END, 1, 4000)) AS block_md5 FROM policy_pages"""),
)
def x24(spark, d):
    from ..functions.prompts import guide_block

    return A.policy_pages(spark, d).withColumn("slot", F.lit(1)).select("service_key", F.md5(guide_block()).alias("block_md5"))


@query(
    "F13_missing_detail",
    with_roles(["jobs"], "SELECT refnr, title_de, is_active FROM jobs WHERE description_de IS NULL OR length(description_de) <= 20 ORDER BY is_active, refnr"),
)
def f13(spark, d):
    return job_ops.jobs_missing_detail(A.jobs(spark, d))


@query(
    "F13_missing_detail_strict_top",
    with_roles(["jobs"], "SELECT refnr, title_de, is_active FROM jobs WHERE description_de IS NULL OR length(description_de) < 20 ORDER BY is_active, refnr LIMIT 100"),
)
def f13_strict(spark, d):
    return job_ops.jobs_missing_detail(A.jobs(spark, d), 100, strict=True)


PENDING = {
    "description": "SELECT refnr, title_de FROM jobs WHERE length(description_de) > 20 AND coalesce(description_zh, '') = ''",
    "title": "SELECT refnr, title_de FROM jobs WHERE coalesce(title_zh, '') = ''",
    "active_title": "SELECT refnr, title_de FROM jobs WHERE is_active AND coalesce(title_zh, '') = ''",
    "title_null": "SELECT refnr, title_de FROM jobs WHERE title_zh IS NULL",
}


def _register_pending(kind: str, sql: str) -> None:
    @query(f"F14_pending_{kind}", with_roles(["jobs"], sql))
    def pending(spark, d):
        return job_ops.pending_work(A.jobs(spark, d), kind).select("refnr", "title_de")


for _kind, _sql in PENDING.items():
    _register_pending(_kind, _sql)


@query(
    "F14_pending_policy",
    with_roles(["policy_pages"], "SELECT service_key, md5(coalesce(summary_zh, title_de)) AS content_md5 FROM policy_pages WHERE NOT translated ORDER BY last_fetched_at DESC NULLS FIRST, service_key LIMIT 50"),
)
def f14_policy(spark, d):
    return job_ops.pending_work(A.policy_pages(spark, d), "policy", 50).select("service_key", F.md5("content").alias("content_md5"))


@query(
    "F15_missing_tags",
    with_roles(["jobs"], "SELECT refnr, title_de FROM jobs WHERE is_active AND length(description_zh) > 10 AND coalesce(len(tags), 0) = 0"),
)
def f15(spark, d):
    return job_ops.jobs_missing_tags(A.jobs(spark, d)).select("refnr", "title_de")


@query(
    "F16_review_candidates",
    with_roles(["policies_v1"], "SELECT id, region_name FROM policies_v1 WHERE status = 'published' AND region_name ILIKE '%ba%' ORDER BY updated_at DESC NULLS FIRST, id LIMIT 20"),
)
def f16(spark, d):
    return job_ops.review_candidates(A.policies_v1(spark, d), 20, region="BA", status="published").select("id", "region_name")


SCRAPE = RegionConfig("Sachsen", "州", "Landesregierung Sachsen", "州级政策", "scraper_output_sachsen.json")


@query(
    "S5_drafts_from_scrape",
    """SELECT doc_id, md5(substr(array_to_string(string_split(text, chr(10)), chr(10) || chr(10)), 1, 500)) AS summary_md5,
  md5(array_to_string(string_split(text, chr(10))[1:3], chr(10) || chr(10))) AS summary_de_md5,
  CASE WHEN doc_id % 2 = 0 THEN '2024-05-01' ELSE '2024-07-01' END AS published_at, CASE WHEN doc_id % 2 = 0 THEN '2024-05-01' END AS effective_at,
  substr(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9\\x{4e00}-\\x{9fff}\\s-]', '', 'g'), '\\s+', '-', 'g'), 1, 50)
    || '---' || substr(replace(source || '.example/' || doc_id, '/', '-'), 1, 30) || '---' || substr(md5('https://' || source || '.example/' || doc_id), 1, 8) AS slug,
  'draft' AS status, '待定' AS target_groups FROM documents""",
)
def s5(spark, d):
    items = A.table(spark, d, "documents").select(
        "doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, "2024-05-01").alias("date"), F.split("text", "\n").alias("paragraphs"),
    )
    drafts = drafts_from_scrape(items, SCRAPE, AS_OF)
    return drafts.select(
        F.element_at(F.split("official_url", "/"), -1).cast("bigint").alias("doc_id"),
        F.md5("summary_zh").alias("summary_md5"), F.md5("content_de_summary").alias("summary_de_md5"),
        "published_at", "effective_at", "slug", "status", "target_groups",
    )


ARCHIVE = ArchiveConfig("https://www.guide.example", "mig", "Guide", "Ministerium", "工作与蓝卡")


@query(
    "S6_load_archive_pages",
    """WITH p AS (SELECT doc_id, 'https://www.guide.example/' || source || '/' || doc_id AS url, 'Titel ' || doc_id AS title, text,
    'mig_www_guide_example_' || source || '_' || doc_id AS service_key, string_split(text, chr(10))[1] AS line FROM documents)
SELECT service_key, CASE WHEN length(line) > 30 AND NOT contains(lower(line), 'breadcrumb') THEN substr(line, 1, 100) ELSE title END AS title_de,
  title AS title_zh, md5(substr(text, 1, 5000)) AS summary_md5 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def s6(spark, d):
    pages = A.table(spark, d, "documents").select(
        F.concat(F.lit("en/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.lit("Titel "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), "doc_id", "source",
    )
    known = A.table(spark, d, "labels").join(pages, "doc_id").select(
        F.concat(F.lit("mig_www_guide_example_"), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("service_key")
    )
    out = load_archive_pages(pages, known, ARCHIVE, AS_OF)
    return out.select("service_key", "title_de", "title_zh", F.md5("summary_zh").alias("summary_md5"))
