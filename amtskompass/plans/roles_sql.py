"""The role tables and rule sets once more, as plain SQL for the checks."""

from __future__ import annotations

from ..functions import constants as C
from ..sources import adapters as A


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{sql_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def any_of(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(n)})" for n in needles) + ")"


def first_rule(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(col, n)} THEN {q(label)}" for label, n in rules) + f" ELSE {default} END"


def rule_list(col: str, rules) -> str:
    items = ", ".join(f"CASE WHEN {any_of(col, n)} THEN {q(label)} END" for label, n in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def distinct_in_order(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def lookup(col: str) -> str:
    text = f"lower(trim({col}, ' ' || chr(9) || chr(10) || chr(13)))"
    for p in C.DISCLAIMER_PATTERNS:
        text = f"regexp_replace({text}, {q(p)}, ' ', 'g')"
    return f"regexp_replace({text}, '\\s+', ' ', 'g')"


def alias(text: str, field: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(a[3])}) THEN {q(a[field])}" for a in C.REGION_ALIASES) + " END"


def region_name(name: str, level: str) -> str:
    t = lookup(name)
    return (f"CASE WHEN coalesce({level}, '') = '联邦' OR {any_of(t, C.FEDERAL_NEEDLES)} THEN '联邦'"
            f" ELSE coalesce({alias(t, 0)}, trim({name})) END")


def region_level(level: str, name: str) -> str:
    return f"CASE WHEN {level} IN ('联邦','州','市','Landkreis') THEN {level} ELSE coalesce({alias(lookup(name), 2)}, '州') END"


def region_state(name: str, level: str) -> str:
    return f"CASE WHEN {level} = '联邦' THEN '联邦' ELSE coalesce({alias(lookup(name), 1)}, {region_name(name, level)}) END"


def display_groups(text: str, category: str) -> str:
    implied = f"CASE {category} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.CATEGORY_GROUPS.items())
    implied += f" WHEN '工作与蓝卡' THEN CASE WHEN {any_of(text, C.BLUE_CARD_NEEDLES)} THEN '蓝卡人群' ELSE '工作签人群' END END"
    items = ", ".join(f"CASE WHEN {any_of(text, n)} THEN {q(label)} END" for label, n in C.GROUP_RULES)
    return f"list_filter([{items}, {implied}], lambda x: x IS NOT NULL)"


ROLES: dict[str, str] = {}

ROLES["policies_v1"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 'doc-' || doc_id AS slug,
  string_split(text, chr(10))[-1] AS title_zh, string_split(text, chr(10))[1] AS title_de,
  source AS publisher, 'https://' || source || '.example/' || doc_id AS official_url,
  CASE WHEN doc_id % 40 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) END AS published_at,
  CASE WHEN doc_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) + CAST(doc_id % 60 AS INTEGER) END AS effective_at,
  {pick(A.LEVELS, 'doc_id')} AS region_level, {pick(A.REGIONS, 'doc_id')} AS region_name,
  'cat' || (doc_id % 10) AS category, [lang, source] AS target_groups, text AS summary_zh,
  [{pick(A.PHRASES, 'doc_id')}] AS key_changes, 'note ' || doc_id AS user_notes, source AS impact_zh, text AS content_zh,
  CASE WHEN doc_id % 3 <> 0 THEN lang END AS content_de_summary,
  {pick(A.RISKS, 'doc_id')} AS risk_level, {pick(A.STATUSES, 'doc_id')} AS status,
  n_chars AS view_count, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS updated_at, doc_id
FROM documents"""

ROLES["norm"] = f"""
SELECT *, CASE WHEN len(g1) > 0 THEN list_filter(g1, lambda x, i: list_position(g1, x) = i) ELSE ['可能相关'] END AS grp
FROM (
  SELECT *, {first_rule('txt', C.DISPLAY_CATEGORY_RULES, "'其他'")} AS cat, {region_name('region_name', 'lvl')} AS reg,
    {display_groups('txt', first_rule('txt', C.DISPLAY_CATEGORY_RULES, "'其他'"))} AS g1
  FROM (
    SELECT *, {region_level('region_level', 'region_name')} AS lvl,
      {lookup("concat_ws(' ', nullif(title_zh,''), nullif(title_de,''), nullif(summary_zh,''), key_changes[1], content_de_summary)")} AS txt
    FROM policies_v1))"""

ROLES["policy_pages"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 'key_' || doc_id AS service_key, 'doc-' || doc_id AS slug,
  string_split(text, chr(10))[-1] AS title_zh, string_split(text, chr(10))[1] AS title_de,
  CASE WHEN doc_id % 13 <> 0 THEN text END AS summary_zh,
  CASE doc_id % 3 WHEN 1 THEN [] WHEN 2 THEN [lang] END AS requirements_zh,
  CASE WHEN doc_id % 2 = 0 THEN '10 Euro' ELSE '' END AS fees_zh,
  CASE WHEN doc_id % 5 <> 0 THEN '2 Wochen' END AS duration_zh,
  CASE WHEN doc_id % 4 = 0 THEN [lang, source] ELSE [] END AS steps_zh,
  {pick(A.LEVELS, 'doc_id')} AS region_level, source AS region_name, 'cat' || (doc_id % 10) AS category,
  CASE WHEN doc_id % 17 <> 0 THEN [lang, source] END AS tags, source AS publisher,
  'https://' || source || '.example/' || doc_id AS source_url, source AS source_name,
  doc_id % 7 <> 0 AS translated, md5(text) AS content_hash,
  CASE WHEN doc_id % 50 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 1000 AS INTEGER)) END AS last_fetched_at,
  n_chars AS view_count, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS updated_at, doc_id, lang
FROM documents"""

ROLES["jobs"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS refnr, o_orderkey AS ok,
  {pick(A.JOB_PHRASES, 'o_orderkey')} || ' ' || o_orderpriority AS title_de,
  CASE WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 > 1 THEN 'Stelle ' || o_orderkey END AS title_zh,
  c_name AS employer, n_name AS city, r_name AS state_code,
  CASE o_orderkey % 3 WHEN 0 THEN ['全职'] WHEN 1 THEN ['兼职', '远程'] ELSE [] END AS work_type,
  CASE WHEN o_orderkey % 11 = 1 THEN [] WHEN o_orderkey % 11 > 1 THEN [o_orderpriority, c_mktsegment] END AS tags,
  CASE WHEN o_orderkey % 6 = 1 THEN repeat('x', 20) WHEN o_orderkey % 6 = 2 THEN repeat('x', 21)
    WHEN o_orderkey % 6 > 2 THEN {pick(A.JOB_PHRASES, 'o_orderkey')} || ' bei ' || c_name || ' im Bereich ' || c_mktsegment END AS description_de,
  CASE o_orderkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'kurz' WHEN 3 THEN 'eine lange Beschreibung' END AS description_zh,
  CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS published_at,
  o_orderstatus <> 'F' AS is_active, o_orderkey % 3 <> 0 AS translated, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


def by_event(mapping: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


ROLES["queue"] = f"""
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'policy' ELSE 'job' END AS source_type,
  CAST(user_id AS VARCHAR) AS source_id, CAST(floor(value) AS BIGINT) % 3 AS priority, event_id % 4 AS attempts,
  {by_event(A.QUEUE_STATUS)} AS status, ts AS created_at
FROM events"""

ROLES["reviews"] = f"""
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS policy_id, {by_event(A.REVIEW_STATUS)} AS review_status,
  value / 50 AS confidence, {pick(['keep', 'update', 'unpublish', 'manual_check', 'other'], 'event_id')} AS suggested_action, ts AS reviewed_at
FROM events"""

ROLES["runs"] = f"""
SELECT 'run-' || event_id AS run_id, {pick(A.RUN_MODES, 'event_id')} AS mode, {by_event(A.RUN_STATUS)} AS status,
  user_id % 9 AS source_index, CAST(floor(value) AS BIGINT) AS request_used, ts AS updated_at, ts + INTERVAL 5 HOUR AS next_resume_at
FROM events"""

ROLES["budget"] = """
SELECT user_id AS source_idx, event_id AS pos, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS cost FROM events"""

ROLES["fetches"] = f"""
SELECT page_id, 'page_' || page_id AS service_key, url,
  CASE page_id % 11 WHEN 0 THEN 304 WHEN 1 THEN 404 WHEN 2 THEN 0 ELSE 200 END AS status, 'new-' || page_id AS etag,
  CASE WHEN page_id % 11 = 3 THEN '' WHEN page_id % 11 > 1 THEN CASE WHEN page_id % 3 = 0
    THEN replace(html, '<article>', {q(A.NEW_PARAGRAPH)} || page_id || '</p>') ELSE html END END AS body,
  CASE WHEN page_id % 11 = 2 THEN 'timeout' END AS error
FROM pages"""

ROLES["page_state"] = """
SELECT CASE WHEN page_id % 5 = 0 THEN url || '#moved' ELSE url END AS url, 'old-' || page_id AS etag,
  CASE WHEN page_id % 5 = 0 THEN 'moved_' ELSE 'page_' END || page_id AS service_key, html
FROM pages"""

# one row per search hit; the Spark side reads the same hits from nested JSON pages
ROLES["hits"] = """
SELECT keyword, kw_ord, page, pos, refnr, CASE WHEN l_linenumber <> 3 THEN 'Stelle ' || refnr ELSE 'Beruf' END AS title_de,
  employer, city, state_code, work_type, published_at
FROM (SELECT l_returnflag AS keyword, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS kw_ord,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS page, l_linenumber, l_partkey, l_suppkey,
    'Firma ' || l_suppkey AS employer, CASE WHEN l_linenumber % 4 <> 0 THEN 'Ort ' || l_returnflag ELSE 'Stadt' END AS city,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus ELSE 'Region' END AS state_code,
    CASE WHEN l_linenumber % 2 = 0 THEN ['全职'] ELSE ['兼职', '远程'] END AS work_type, CAST(l_shipdate AS DATE) AS published_at,
    unnest([0, 1]) AS pos, unnest([CAST(l_partkey AS VARCHAR), 'S' || l_suppkey]) AS refnr
  FROM lineitem)"""

ROLES["feed_lines"] = """
SELECT source AS source_id, doc_id, 'https://' || source || '.example/rss/' || doc_id AS url,
  CASE WHEN doc_id % 9 = 0 THEN 500 ELSE 200 END AS status, doc_id % 8 > 1 AS has_items,
  unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
FROM documents"""

ROLES["feed_items"] = """
SELECT source_id, doc_id, pos, trim(regexp_replace(line, '\\s+$', '')) || ' &amp; Antrag' AS title,
  'https://feed.example/' || doc_id || '/' || pos AS link, ' ' || line || '  Gesetz' AS description,
  CASE pos % 3 WHEN 0 THEN '2026-04-22' WHEN 1 THEN '2026-04-21' ELSE '' END AS published_at, status
FROM feed_lines WHERE has_items"""

ROLES["replies"] = """
SELECT CAST(conv_id AS VARCHAR) AS refnr, turn, role, text, (conv_id + turn) % 7 AS shape, 'Titel ' || turn AS title_zh,
  conv_id FROM conversations"""

ROLES["logs"] = """
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS line_no, event_type, user_id, CAST(floor(value) AS BIGINT) AS v FROM events"""


def with_roles(roles: list[str], body: str) -> str:
    """SELECT over the named role tables (in dependency order)."""
    return "WITH " + ",\n".join(f"{r} AS ({ROLES[r]})" for r in roles) + "\n" + body
