"""Listing, search, statistics and related-item queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import format_date, is_new
from ..functions.labels import lookup as dim_lookup
from ..functions.taxonomy import lookup_text, normalize_policies, normalize_regions, taxonomy_source, wanted_region, with_regions
from ..functions.text import computed, contains_any, normalize_text
from ..operators import catalog as cat
from ..operators import stats
from ..operators import visibility as vis
from ..operators.jobs import with_state_code
from ..operators.paging import page_index
from ..operators.related import related
from ..session import reliable_checkpoint
from ..sources import adapters as A
from ..sources.dimensions import dimension
from ..sources.schemas import POLICY_PAGE
from ..sources.tables import existing_keys, read_table
from .registry import query
from .roles_sql import pick as sql_pick
from .roles_sql import q, region_name, region_state as sql_state, with_roles

AS_OF = "2024-06-15 12:00:00"
STATE_NAMES = [*C.STATE_CODES, "Ausland"]


def norm(spark, d):
    return normalize_policies(A.policies_v1(spark, d))


V1 = ["policies_v1"]
NORM = ["policies_v1", "norm"]
PAGES = ["policy_pages"]
JOBS = ["jobs"]


@query("S1_table_scan", with_roles([], "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents").replace("WITH \n", ""))
def s1(spark, d):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    scan = read_table(spark, f"{d}/documents.parquet", T.StructType.fromDDL(schema), ["doc_id", "lang", "source", "text"])
    return scan.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("S2_existing_keys", with_roles(V1, "SELECT DISTINCT official_url FROM policies_v1 WHERE official_url IS NOT NULL"))
def s2(spark, d):
    return existing_keys(A.policies_v1(spark, d), "official_url")


@query("V1_visible_policies", with_roles(V1, "SELECT id, slug FROM policies_v1 WHERE status = 'published'"))
def v1_policies(spark, d):
    return vis.visible(A.policies_v1(spark, d), "policy_v1").select("id", "slug")


@query("V1_visible_jobs", with_roles(JOBS, "SELECT refnr FROM jobs WHERE translated AND is_active"))
def v1_jobs(spark, d):
    return vis.visible(A.jobs(spark, d), "job").select("refnr")


@query(
    "F1_list_policies_v1",
    with_roles(NORM, """
SELECT id, slug, reg AS region_name, lvl AS region_level, cat AS category, array_to_string(grp, '|') AS target_groups
FROM norm WHERE status = 'published' AND published_at >= DATE '2024-02-01' AND published_at <= DATE '2024-11-30'
  AND contains(regexp_replace(lower(concat_ws(' ', title_zh, title_de, publisher, reg, cat, summary_zh, content_zh,
      array_to_string(grp, ' '))), '\\s+', ' ', 'g'), 'an')"""),
)
def f1(spark, d):
    f = cat.PolicyFilters(date_from="2024-02-01", date_to="2024-11-30", query=" AN ")
    rows = cat.list_policies_v1(A.policies_v1(spark, d), f, AS_OF)
    return rows.select("id", "slug", "region_name", "region_level", "category", "target_groups")


@query(
    "F1_list_policies_v1_region_group",
    with_roles(NORM, f"""
SELECT id, reg AS region_name, cat AS category FROM norm
WHERE (reg = 'Baden-Württemberg' OR {sql_state('reg', 'lvl')} = 'Baden-Württemberg') AND list_contains(grp, '新移民')
  AND status <> 'x'"""),
)
def f1_region(spark, d):
    f = cat.PolicyFilters(region_name="baden w", target_group="新移民", status="all")
    rows = cat.list_policies_v1(A.policies_v1(spark, d), f, AS_OF, include_hidden=True)
    return rows.select("id", "region_name", "category")


@query(
    "F1_list_policies_v1_page",
    with_roles(NORM, """
SELECT id, published_at::VARCHAR AS published_at, cat AS category, view_count FROM norm
WHERE status = 'published' AND lvl = '市' AND region_level = '市'
ORDER BY CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, published_at DESC NULLS LAST, id LIMIT 20 OFFSET 20"""),
)
def f1_page(spark, d):
    rows = cat.list_policies_v1(A.policies_v1(spark, d), cat.PolicyFilters(region_level="市"), AS_OF)
    page = cat.paginate(rows, cat.policy_order("risk_level"), 2, 20)
    return page.select("id", "published_at", "category", "view_count")


@query(
    "F2_list_policies_v2",
    with_roles(PAGES, """
SELECT id, slug, category, view_count FROM policy_pages
WHERE translated AND list_has_any(tags, ['de', 'src3'])
  AND (title_zh ILIKE '%e_n%' OR title_de ILIKE '%e_n%' OR summary_zh ILIKE '%e_n%')"""),
)
def f2(spark, d):
    rows = cat.list_policies_v2(A.policy_pages(spark, d), cat.PageFilters(tags=["de", "src3"], query="e_n"))
    return rows.select("id", "slug", "category", "view_count")


def flagship(spark, d):
    """Second-generation list: facets, overlap, pattern, order and page."""
    f = cat.PageFilters(region_level="州", tags=["de", "en"], query="an")
    rows = cat.list_policies_v2(A.policy_pages(spark, d), f)
    page = cat.paginate(rows, cat.page_order(), 1, 20)
    return page.select("id", "slug", "category", "region_name", "view_count", "last_fetched_at")


query(
    "F2_list_policies_v2_page",
    with_roles(PAGES, """
SELECT id, slug, category, region_name, view_count, strftime(last_fetched_at, '%Y-%m-%d %H:%M:%S') AS last_fetched_at
FROM policy_pages WHERE translated AND region_level = '州' AND list_has_any(tags, ['de', 'en'])
  AND (title_zh ILIKE '%an%' OR title_de ILIKE '%an%' OR summary_zh ILIKE '%an%')
ORDER BY policy_pages.last_fetched_at DESC NULLS FIRST, id LIMIT 20"""),
)(flagship)


@query(
    "O2_v2_sort_by_views",
    with_roles(PAGES, "SELECT id, view_count FROM policy_pages WHERE translated ORDER BY view_count DESC NULLS FIRST, id LIMIT 50 OFFSET 50"),
)
def o2(spark, d):
    rows = cat.list_policies_v2(A.policy_pages(spark, d), cat.PageFilters())
    return cat.paginate(rows, cat.page_order("view_count"), 2, 50).select("id", "view_count")


@query(
    "F3_list_jobs",
    with_roles(JOBS, """
SELECT refnr, title_de, employer, city FROM jobs WHERE is_active AND translated AND list_has_any(work_type, ['远程', '全职'])
  AND list_has_any(tags, ['1-URGENT', 'BUILDING']) AND (title_zh ILIKE '%1%' OR title_de ILIKE '%1%' OR employer ILIKE '%1%')"""),
)
def f3(spark, d):
    f = cat.JobFilters(work_type=["远程", "全职"], tags=["1-URGENT", "BUILDING"], query="1")
    return cat.list_jobs(A.jobs(spark, d), f).select("refnr", "title_de", "employer", "city")


@query(
    "F3_list_jobs_page",
    with_roles(JOBS, """
SELECT refnr, published_at::VARCHAR AS published_at FROM jobs WHERE is_active AND translated AND state_code = 'ASIA'
ORDER BY jobs.published_at DESC NULLS FIRST, refnr LIMIT 20 OFFSET 40"""),
)
def f3_page(spark, d):
    rows = cat.list_jobs(A.jobs(spark, d), cat.JobFilters(state_code="ASIA"))
    return cat.paginate(rows, cat.job_order(), 3, 20).select("refnr", "published_at")


@query(
    "F4_text_search",
    with_roles(V1, """
SELECT id FROM policies_v1 WHERE contains(regexp_replace(lower(concat_ws(' ', title_zh, title_de, publisher, region_name, category,
  summary_zh, content_zh, array_to_string(target_groups, ' '))), '\\s+', ' ', 'g'), 'der die')"""),
)
def f4(spark, d):
    return cat.where_text(A.policies_v1(spark, d), cat.SEARCH_FIELDS, "target_groups", "DER   die").select("id")


@query(
    "F5_region_match",
    with_roles(V1, f"""
SELECT id, ({region_name('region_name', 'region_level')} = 'Bayern' OR {sql_state('region_name', 'region_level')} = 'Bayern') AS hit
FROM policies_v1"""),
)
def f5(spark, d):
    want = wanted_region("Bavaria")
    rows = with_regions(A.policies_v1(spark, d))
    return rows.select("id", ((F.col("_region") == want) | (F.col("_state") == want)).alias("hit"))


@query(
    "F6_search_all",
    with_roles(PAGES + JOBS, """
(SELECT 'policy' AS kind, id AS key, title_zh, title_de FROM policy_pages WHERE translated
  AND (title_zh ILIKE '%ung%' OR title_de ILIKE '%ung%' OR summary_zh ILIKE '%ung%') ORDER BY id LIMIT 10)
UNION ALL
(SELECT 'job', refnr, title_zh, title_de FROM jobs WHERE translated AND is_active
  AND (title_zh ILIKE '%ung%' OR title_de ILIKE '%ung%' OR employer ILIKE '%ung%') ORDER BY refnr LIMIT 10)"""),
)
def f6(spark, d):
    return cat.search_all(A.policy_pages(spark, d), A.jobs(spark, d), "ung")


@query(
    "F7_point_lookup",
    with_roles(V1 + JOBS, """
SELECT 'v1' AS kind, id AS key FROM policies_v1 WHERE id = '8' AND status IN ('published', 'expired')
UNION ALL SELECT 'slug', id FROM policies_v1 WHERE slug = 'doc-11' AND status = 'published'
UNION ALL SELECT 'job', refnr FROM jobs WHERE refnr = '100' AND is_active AND translated"""),
)
def f7(spark, d):
    p, j = A.policies_v1(spark, d), A.jobs(spark, d)
    by_id = vis.get_by_id_or_slug(p, "8").select(F.lit("v1").alias("kind"), F.col("id").alias("key"))
    by_slug = vis.get_by(p, "slug", "doc-11", "policy_v1").select(F.lit("slug").alias("kind"), F.col("id").alias("key"))
    job = vis.get_by(j, "refnr", "100", "job").select(F.lit("job").alias("kind"), F.col("refnr").alias("key"))
    return by_id.unionByName(by_slug).unionByName(job)


@query(
    "F8_within_days",
    with_roles(V1, "SELECT id FROM policies_v1 WHERE CAST(published_at AS TIMESTAMP) >= TIMESTAMP '2024-06-15 12:00:00' - INTERVAL 30 DAY"),
)
def f8(spark, d):
    f = cat.PolicyFilters(days=30)
    return cat.list_policies_v1(A.policies_v1(spark, d), f, AS_OF, include_hidden=True, normalized=True).select("id")


@query(
    "F9_is_new",
    with_roles(JOBS, """
SELECT refnr, coalesce(epoch(TIMESTAMP '1998-06-15 12:00:00') - epoch(CAST(published_at AS TIMESTAMP)) < 259200, false) AS is_new FROM jobs"""),
)
def f9(spark, d):
    return A.jobs(spark, d).select("refnr", is_new(F.col("published_at"), "1998-06-15 12:00:00").alias("is_new"))


@query(
    "F10_has_guide",
    with_roles(PAGES, """
SELECT id, coalesce(len(requirements_zh), 0) > 0 OR fees_zh <> '' OR coalesce(duration_zh, '') <> '' OR len(steps_zh) > 0 AS has_guide FROM policy_pages"""),
)
def f10(spark, d):
    return A.policy_pages(spark, d).select("id", vis.has_guide().alias("has_guide"))


@query(
    "F11_public_projection",
    with_roles(PAGES + JOBS, """
SELECT id AS key, '' AS title, array_to_string(coalesce(tags, []), '|') AS tags, array_to_string(coalesce(requirements_zh, []), '|') AS extra,
  coalesce(duration_zh, '') AS text FROM policy_pages
UNION ALL SELECT refnr, coalesce(title_zh, title_de), array_to_string(coalesce(tags, []), '|'), array_to_string(work_type, '|'), '' FROM jobs"""),
)
def f11(spark, d):
    p = vis.project_public(A.policy_pages(spark, d), "policy").select(
        F.col("id").alias("key"), F.lit("").alias("title"), "tags", F.col("requirements_zh").alias("extra"),
        F.col("duration_zh").alias("text"),
    )
    j = vis.project_public(A.jobs(spark, d), "job").select(
        F.col("refnr").alias("key"), F.col("display_title").alias("title"), "tags", F.col("work_type").alias("extra"), F.lit("").alias("text"),
    )
    return p.unionByName(j)


@query(
    "F12_search_result",
    with_roles(NORM, """
SELECT id, slug, md5(title_zh) AS title_md5, reg AS region_name, published_at::VARCHAR AS published_at, cat AS category,
  array_to_string(grp, '|') AS target_groups, official_url, risk_level
FROM norm WHERE status = 'published'
  AND contains(regexp_replace(lower(concat_ws(' ', title_zh, title_de, publisher, reg, cat, summary_zh, content_zh,
      array_to_string(grp, ' '))), '\\s+', ' ', 'g'), 'src7')
ORDER BY norm.published_at DESC NULLS LAST, id LIMIT 20"""),
)
def f12(spark, d):
    rows = cat.list_policies_v1(A.policies_v1(spark, d), cat.PolicyFilters(query="src7"), AS_OF)
    page = cat.paginate(rows, cat.policy_order(), 1, 20)
    return vis.search_result(page, "src7").withColumn("title_md5", F.md5("title_zh")).drop("title_zh", "summary_zh")


O1_SORTS = {
    "published_at": "published_at DESC NULLS LAST, id",
    "effective_at": "coalesce(effective_at, published_at) DESC NULLS LAST, published_at DESC NULLS LAST, id",
    "risk_level": "CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, published_at DESC NULLS LAST, id",
    "view_count": "view_count DESC, published_at DESC NULLS LAST, id",
}


@query(
    "O1_sort_policies",
    with_roles(V1, "\nUNION ALL\n".join(
        f"(SELECT '{k}' AS sort, row_number() OVER (ORDER BY {o}) AS pos, id FROM policies_v1)" for k, o in O1_SORTS.items()
    )),
)
def o1(spark, d):
    from ..operators.ranking import global_rank

    p = A.policies_v1(spark, d).select("id", "published_at", "effective_at", "risk_level", "view_count")
    parts = [global_rank(p, cat.policy_order(s), "pos").select(F.lit(s).alias("sort"), "pos", "id") for s in O1_SORTS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "O3_page_summary",
    with_roles(PAGES, """
SELECT count(*) AS total, 3 AS page, 20 AS page_size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages,
  CASE WHEN count(*) = 0 THEN 0 ELSE 41 END AS from_row, least(60, count(*)) AS to_row FROM policy_pages WHERE translated"""),
)
def o3(spark, d):
    return cat.page_summary(cat.list_policies_v2(A.policy_pages(spark, d), cat.PageFilters()), 3, 20)


PAGE_OF_JOBS = """
SELECT refnr, published_at, title_de FROM jobs WHERE translated AND is_active ORDER BY jobs.published_at DESC NULLS FIRST, refnr LIMIT {size} OFFSET {skip}"""


def _register_seek(name: str, page: int, size: int) -> None:
    @query(name, with_roles(JOBS, PAGE_OF_JOBS.format(size=size, skip=(page - 1) * size)).replace("SELECT refnr, published_at, title_de", "SELECT refnr, CAST(published_at AS VARCHAR) AS published_at, title_de"))
    def seek(spark, d):
        shown = cat.list_jobs(A.jobs(spark, d), cat.JobFilters()).select("refnr", "published_at", "title_de")
        return page_index(shown, cat.job_order(), 64).page(page, size)


_register_seek("O3_seek_page_7", 7, 20)
_register_seek("O3_seek_page_500", 500, 10)


@query(
    "O4_top_recent",
    with_roles(V1, "SELECT id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM policies_v1 ORDER BY policies_v1.updated_at DESC, id LIMIT 250"),
)
def o4(spark, d):
    return cat.top_recent(A.policies_v1(spark, d)).select("id", "updated_at")


@query(
    "O5_suggestions",
    with_roles(NORM, """, terms AS (
  SELECT published_at, id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (
    SELECT published_at, id, list_concat([cat, reg], grp, list_filter(string_split(trim(regexp_replace(lower(title_de), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 4)) AS t FROM norm WHERE status = 'published'))
SELECT term, id AS first_id FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY published_at DESC NULLS LAST, id, pos) AS rn FROM terms)
WHERE rn = 1 ORDER BY published_at DESC NULLS LAST, id, pos LIMIT 12""".replace(", terms", ", terms", 1)),
)
def o5(spark, d):
    return cat.suggestions(vis.visible(A.policies_v1(spark, d), "policy_v1"), 12, normalize_policies)


@query("A1_category_stats_v1", with_roles(NORM, "SELECT cat AS category, count(*) AS n FROM norm WHERE status = 'published' GROUP BY 1"))
def a1(spark, d):
    shown = vis.visible(A.policies_v1(spark, d), "policy_v1")
    return stats.category_stats(normalize_policies(shown, regions=False, groups=False))


@query("A1_category_stats_v2", with_roles(PAGES, "SELECT category, count(*) AS n FROM policy_pages WHERE translated GROUP BY 1"))
def a1_v2(spark, d):
    return stats.category_stats(vis.visible(A.policy_pages(spark, d), "policy"))


@query("A2_group_stats", with_roles(NORM, "SELECT target_group, count(*) AS n FROM (SELECT unnest(grp) AS target_group FROM norm WHERE status = 'published') GROUP BY 1"))
def a2(spark, d):
    return stats.group_stats(normalize_policies(vis.visible(A.policies_v1(spark, d), "policy_v1"), regions=False))


@query("A3_region_stats", with_roles(NORM, "SELECT reg AS region_name, count(*) AS n FROM norm WHERE status = 'published' GROUP BY 1"))
def a3(spark, d):
    return stats.region_stats(normalize_regions(vis.visible(A.policies_v1(spark, d), "policy_v1")))


@query(
    "A4_admin_stats",
    with_roles(V1, """
SELECT count(*) AS total, count(*) FILTER (risk_level = 'high') AS high_risk, count(*) FILTER (status = 'draft') AS draft,
  count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'unpublished') AS unpublished,
  count(*) FILTER (status = 'expired') AS expired, count(DISTINCT status) AS used_statuses FROM policies_v1"""),
)
def a4(spark, d):
    return stats.admin_stats(A.policies_v1(spark, d))


@query(
    "A5_job_status",
    with_roles(JOBS, """
SELECT count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive,
  count(*) FILTER (is_active AND title_zh IS NULL) AS active_missing_title_zh,
  count(*) FILTER (is_active AND description_de IS NULL) AS active_missing_desc_de,
  count(*) FILTER (NOT is_active AND length(description_de) > 20 AND description_zh IS NOT NULL AND title_zh IS NOT NULL) AS ready_to_activate,
  count(*) FILTER (NOT is_active) AS waiting_for_fetch,
  count(*) FILTER (NOT is_active AND description_de IS NULL) AS waiting_for_fetch_strict,
  count(*) FILTER (NOT is_active AND length(description_de) > 20 AND description_zh IS NULL) AS waiting_for_translate,
  count(*) FILTER (NOT is_active AND length(description_de) > 20 AND description_zh IS NOT NULL AND title_zh IS NULL) AS waiting_for_title
FROM jobs"""),
)
def a5(spark, d):
    return stats.job_status(A.jobs(spark, d))


@query(
    "A8_region_tree",
    with_roles(NORM, f"""
SELECT state, coalesce(list_position({str(list(C.STATE_CODES))}, state) - 1, 999) AS state_order,
  coalesce(array_to_string(list(city ORDER BY city) FILTER (city <> state), '|'), '') AS cities
FROM (SELECT DISTINCT {sql_state('reg', 'lvl')} AS state, reg AS city FROM norm WHERE lvl <> '联邦') GROUP BY state"""),
)
def a8(spark, d):
    return stats.region_tree(normalize_regions(A.policies_v1(spark, d)))


@query(
    "A9_facets",
    with_roles(PAGES, """, page AS (SELECT id, last_fetched_at AS t, tags FROM policy_pages WHERE translated AND category = 'cat3' ORDER BY last_fetched_at DESC NULLS FIRST, id LIMIT 20)
SELECT DISTINCT unnest(tags) AS value FROM page"""),
)
def a9(spark, d):
    rows = cat.list_policies_v2(A.policy_pages(spark, d), cat.PageFilters(category="cat3"))
    page = cat.paginate(rows, cat.page_order(), 1, 20).withColumn("day", -F.unix_seconds("last_fetched_at"))
    return cat.facets(page, F.col("tags"), ["day", "id"])


@query(
    "J9_related",
    with_roles(NORM, """
SELECT id, related_id, score, rank FROM (
  SELECT a.id, b.id AS related_id,
    CASE WHEN a.reg = b.reg THEN 3 ELSE 0 END + CASE WHEN a.cat = b.cat THEN 3 ELSE 0 END
    + CASE WHEN a.publisher = b.publisher THEN 2 ELSE 0 END + CASE WHEN list_has_any(a.grp, b.grp) THEN 1 ELSE 0 END AS score,
    row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.published_at DESC NULLS LAST, b.id) AS rank
  FROM norm a, norm b WHERE a.id <> b.id AND a.status = 'published' AND b.status = 'published')
WHERE score > 0 AND rank <= 3"""),
)
def j9(spark, d):
    # the rules read whole texts: apply them once, and keep the few columns that are scored
    shown = normalize_policies(vis.visible(A.policies_v1(spark, d), "policy_v1"))
    return related(reliable_checkpoint(shown.select("id", "region_name", "category", "publisher", "target_groups", "published_at", "status")), 3)


@query(
    "W1_related_top5",
    with_roles(PAGES, """
SELECT id, related_id, score, rank FROM (
  SELECT a.id, b.id AS related_id,
    CASE WHEN a.region_name = b.region_name THEN 3 ELSE 0 END + CASE WHEN a.category = b.category THEN 3 ELSE 0 END
    + CASE WHEN a.publisher = b.publisher THEN 2 ELSE 0 END + CASE WHEN list_has_any(a.tags, b.tags) THEN 1 ELSE 0 END AS score,
    row_number() OVER (PARTITION BY a.id ORDER BY score DESC, CAST(b.last_fetched_at AS DATE) DESC NULLS LAST, b.id) AS rank
  FROM policy_pages a, policy_pages b WHERE a.id <> b.id)
WHERE score > 0 AND rank <= 5"""),
)
def w1(spark, d):
    p = A.policy_pages(spark, d).withColumns({"target_groups": F.col("tags"), "published_at": F.col("last_fetched_at").cast("date")})
    return related(p, 5)


@query(
    "C1_display_category",
    with_roles(NORM, "SELECT id, cat AS category FROM norm"),
)
def c1(spark, d):
    return normalize_policies(A.policies_v1(spark, d), regions=False, groups=False).select("id", "category")


@query("C2_display_groups", with_roles(NORM, "SELECT id, array_to_string(grp, '|') AS target_groups FROM norm"))
def c2(spark, d):
    return normalize_policies(A.policies_v1(spark, d), regions=False).select("id", "target_groups")


@query(
    "C4_region_name",
    with_roles(V1, f"SELECT id, {region_name('region_name', 'region_level')} AS region FROM policies_v1"),
)
def c4(spark, d):
    return with_regions(A.policies_v1(spark, d)).select("id", F.col("_region").alias("region"))


@query("C5_region_level", with_roles(NORM, "SELECT id, lvl AS region_level FROM norm"))
def c5(spark, d):
    return with_regions(A.policies_v1(spark, d)).select("id", F.col("_level").alias("region_level"))


@query("C6_region_state", with_roles(V1, f"SELECT id, {sql_state('region_name', 'region_level')} AS state FROM policies_v1"))
def c6(spark, d):
    return with_regions(A.policies_v1(spark, d)).select("id", F.col("_state").alias("state"))


@query(
    "C17_normalize_policies",
    with_roles(NORM, "SELECT id, cat AS category, array_to_string(grp, '|') AS target_groups, lvl AS region_level, reg AS region_name FROM norm"),
)
def c17(spark, d):
    return norm(spark, d).select("id", "category", "target_groups", "region_level", "region_name")


@query(
    "J10_dimension_lookup",
    with_roles(JOBS, f"""
SELECT refnr, CASE state_code {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.STATE_CODES.items())} END AS code,
  CASE lower(substr(city, 1, 2)) {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.WORK_TYPES.items())} END AS work_label FROM jobs"""),
)
def j10(spark, d):
    return A.jobs(spark, d).select(
        "refnr", dim_lookup(F.col("state_code"), C.STATE_CODES).alias("code"),
        dim_lookup(F.lower(F.substring("city", 1, 2)), C.WORK_TYPES).alias("work_label"),
    )


@query(
    "J10_state_codes",
    with_roles(JOBS, f"""
SELECT refnr, s AS state_code, CASE s {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.STATE_CODES.items())} END AS code
FROM (SELECT refnr, {sql_pick(STATE_NAMES, 'CAST(refnr AS BIGINT)')} AS s FROM jobs)"""),
)
def j10_states(spark, d):
    """Dimension table joined by the region name of the job; an unknown name has no code."""
    rows = A.jobs(spark, d).withColumn("state_code", A.pick(STATE_NAMES, F.col("refnr").cast("bigint")))
    return with_state_code(rows, dimension(spark, "states")).select("refnr", "state_code", "code")


@query(
    "X1_normalize_text",
    "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS normalized_md5 FROM documents",
)
def x1(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("normalized_md5"))


@query(
    "X2_includes_text",
    "SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'der') AS hit FROM documents",
)
def x2(spark, d):
    return A.table(spark, d, "documents").select("doc_id", contains_any(normalize_text(F.col("text")), ["the", "der"]).alias("hit"))


@query(
    "X4_lookup_text",
    with_roles(NORM, "SELECT id, md5(txt) AS text_md5 FROM norm"),
)
def x4(spark, d):
    source = taxonomy_source(F.col("title_zh"), F.col("title_de"), F.col("summary_zh"), F.col("key_changes"), F.col("content_de_summary"))
    rows = computed(A.policies_v1(spark, d), {"source": source})
    return rows.select("id", F.md5(lookup_text(F.col("source"))).alias("text_md5"))


@query(
    "X9_format_date",
    with_roles(V1, """
SELECT id, CASE WHEN published_at IS NULL THEN '未注明'
  ELSE year(published_at) || '年' || month(published_at) || '月' || day(published_at) || '日' END AS shown FROM policies_v1"""),
)
def x9(spark, d):
    return A.policies_v1(spark, d).select("id", format_date(F.col("published_at").cast("string")).alias("shown"))


@query(
    "A10_completeness",
    with_roles(PAGES, """
SELECT source_name, category, count(*) AS guides, count(*) FILTER (coalesce(len(requirements_zh), 0) > 0 AND fees_zh <> '' AND coalesce(duration_zh, '') <> '' AND len(steps_zh) > 0) AS complete,
  count(*) FILTER (coalesce(len(requirements_zh), 0) > 0 AND fees_zh <> '' AND coalesce(duration_zh, '') <> '' AND len(steps_zh) > 0) / count(*) AS share
FROM policy_pages GROUP BY 1, 2"""),
)
def a10(spark, d):
    return stats.completeness(A.policy_pages(spark, d), ["source_name", "category"])


SCHEMA = POLICY_PAGE
