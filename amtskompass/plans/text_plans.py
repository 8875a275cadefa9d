"""Scalar function, label and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import keys, labels, replies, taxonomy, text
from ..functions.dates import normalize_date
from ..operators import runs
from ..sources import adapters as A
from .registry import query
from .roles_sql import any_of, first_rule, q, rule_list, sql_list, with_roles

LIST = lambda e: f"array_to_string({e}, '|')"


@query(
    "C3_ingest_category",
    f"""SELECT doc_id, CASE WHEN raw IN ({', '.join(q(c) for c in C.INGEST_CATEGORIES)}) THEN raw ELSE {first_rule('t', C.INGEST_CATEGORY_RULES, "'其他'")} END AS category
FROM (SELECT doc_id, raw, lower(concat_ws(' ', raw, text, phrase)) AS t FROM (
  SELECT doc_id, text, {sql_list(A.PHRASES)}[CAST(doc_id % 14 AS INTEGER) + 1] AS phrase, CASE doc_id % 3 WHEN 0 THEN '税务与社保' WHEN 1 THEN 'Sonstiges' ELSE 'kita' END AS raw FROM documents))""",
)
def c3(spark, d):
    i = F.col("doc_id")
    rows = A.table(spark, d, "documents").select(
        "doc_id", "text", A.pick(A.PHRASES, i).alias("phrase"),
        F.when(i % 3 == 0, " 税务与社保 ").when(i % 3 == 1, "Sonstiges").otherwise(" ").alias("reply"), F.lit("kita").alias("fallback"),
    )
    raw = text.text_or(F.col("reply"), F.col("fallback"))
    rows = text.computed(rows, {"t": taxonomy.ingest_text(F.array(raw, F.col("text"), F.col("phrase")))})
    return rows.select("doc_id", taxonomy.ingest_category(F.col("reply"), F.col("fallback"), F.col("t")).alias("category"))


@query(
    "C7_ingest_groups",
    f"""SELECT doc_id, CASE WHEN len(g) = 0 THEN '可能相关' ELSE {LIST('list_filter(g, lambda x, i: list_position(g, x) = i)')} END AS target_groups
FROM (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['车主'] ELSE [] END, {rule_list('t', C.GROUP_RULES)}) AS g
  FROM (SELECT doc_id, lower(concat_ws(' ', text, {sql_list(A.PHRASES)}[CAST(doc_id % 14 AS INTEGER) + 1])) AS t FROM documents))""",
)
def c7(spark, d):
    i = F.col("doc_id")
    rows = A.table(spark, d, "documents").select(
        "doc_id", F.when(i % 2 == 0, F.array(F.lit(" 车主 "), F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("reply"),
        taxonomy.ingest_text(F.array(F.col("text"), A.pick(A.PHRASES, i))).alias("t"),
    )
    rows = text.computed(rows, {"t": F.col("t")})
    return rows.select("doc_id", taxonomy.ingest_groups(F.col("reply"), F.col("t"), F.array(F.lit(C.DEFAULT_GROUP))).alias("target_groups"))


@query(
    "C8_ingest_level",
    """SELECT s_suppkey, CASE WHEN contains(t, '联邦') OR contains(lower(t), 'bund') THEN '联邦' WHEN contains(t, 'Landkreis') OR contains(t, '县') THEN 'Landkreis'
  WHEN contains(t, '市') OR contains(lower(t), 'stadt') OR contains(lower(t), 'city') THEN '市' WHEN contains(t, '州') OR contains(lower(t), 'land') OR contains(lower(t), 'state') THEN '州' ELSE '市' END AS level
FROM (SELECT s_suppkey, coalesce(nullif(['Bundesland', 'Landkreis X', 'Hauptstadt', 'Deutschland', 'anders', ''][CAST(s_suppkey % 6 AS INTEGER) + 1], ''), '市') AS t FROM supplier)""",
)
def c8(spark, d):
    value = A.pick(["Bundesland", "Landkreis X", "Hauptstadt", "Deutschland", "anders", ""], F.col("s_suppkey"))
    return A.table(spark, d, "supplier").select("s_suppkey", taxonomy.ingest_level(value, F.lit("市")).alias("level"))


@query("C9_job_tags", f"SELECT doc_id, {LIST(rule_list('t', C.JOB_TAG_RULES))} AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def c9(spark, d):
    return A.table(spark, d, "documents").select("doc_id", labels.job_tags(F.col("text")).alias("tags"))


@query(
    "C9_job_tags_orders",
    with_roles(["jobs"], f"SELECT refnr, {LIST(rule_list('t', C.JOB_TAG_RULES))} AS tags FROM (SELECT refnr, lower(coalesce(description_de, '')) AS t FROM jobs)"),
)
def c9_orders(spark, d):
    return A.jobs(spark, d).select("refnr", labels.job_tags(F.col("description_de")).alias("tags"))


@query(
    "C10_clean_tag_reply",
    with_roles(["jobs"], f"""SELECT refnr, CASE WHEN length(coalesce(trim(description_de), '')) < 20 OR len(valid) = 0 THEN {LIST(rule_list("lower(coalesce(description_de, ''))", C.JOB_TAG_RULES))} ELSE {LIST('valid')} END AS tags
FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(reply, '[,，]'), lambda t: trim(t)), lambda t: length(t) <= 15 AND list_contains({sql_list(C.JOB_TAGS)}, t)) AS valid
  FROM (SELECT *, ['IT/技术, 英语即可', 'unbekannt', '家政/服务，客服/前台,falsch', ''][CAST(ok % 4 AS INTEGER) + 1] AS reply FROM jobs))"""),
)
def c10(spark, d):
    reply = A.pick(["IT/技术, 英语即可", "unbekannt", "家政/服务，客服/前台,falsch", ""], F.col("refnr").cast("bigint"))
    return A.jobs(spark, d).select("refnr", labels.clean_tag_reply(F.col("description_de"), reply).alias("tags"))


@query(
    "C11_work_type_codes",
    with_roles(["jobs"], """SELECT refnr, CASE ok % 3 WHEN 0 THEN '全职|迷你岗' WHEN 1 THEN '' ELSE '实习' END AS work_type FROM jobs"""),
)
def c11(spark, d):
    n = F.col("refnr").cast("bigint") % 3
    codes = F.when(n == 0, F.array(F.lit("VZ"), F.lit("zz"), F.lit("mj"))).when(n == 2, F.array(F.lit("Aa")))
    return A.jobs(spark, d).select("refnr", labels.work_type_from_codes(codes).alias("work_type"))


@query(
    "C12_infer_work_type",
    with_roles(["jobs"], f"""SELECT refnr, CASE WHEN len(w) = 0 THEN '全职' ELSE {LIST('list_filter(w, lambda x, i: list_position(w, x) = i)')} END AS work_type FROM (
  SELECT refnr, list_filter([CASE WHEN ok % 5 = 0 THEN '迷你岗' END, CASE WHEN ok % 7 = 0 THEN '兼职' END, CASE WHEN contains(t, 'vollzeit') THEN '全职' END,
    CASE WHEN contains(t, 'teilzeit') THEN '兼职' END, CASE WHEN {any_of('t', C.REMOTE_NEEDLES)} THEN '远程' END], lambda x: x IS NOT NULL) AS w
  FROM (SELECT refnr, ok, lower(coalesce(description_de, '') || ' ' || title_de) AS t FROM jobs))"""),
)
def c12(spark, d):
    n = F.col("refnr").cast("bigint")
    return A.jobs(spark, d).select(
        "refnr",
        labels.infer_work_type(n % 5 == 0, n % 7 == 0, F.lit(None).cast("boolean"), F.col("title_de"), F.col("description_de")).alias("work_type"),
    )


@query(
    "C13_office_topic",
    f"SELECT doc_id, {first_rule('t', C.OFFICE_TOPIC_RULES, q(C.OFFICE_TOPIC_DEFAULT))} AS topic FROM (SELECT doc_id, lower(string_split(text, chr(10))[1]) || ' ' || lower('https://' || source) AS t FROM documents)",
)
def c13(spark, d):
    title = F.element_at(F.split("text", "\n"), 1)
    return A.table(spark, d, "documents").select("doc_id", labels.office_topic(title, F.concat(F.lit("https://"), "source")).alias("topic"))


@query(
    "C14_office_title",
    f"SELECT doc_id, CASE {' '.join(f'WHEN contains(t, {q(k)}) THEN {q(v)}' for k, v in C.OFFICE_TITLES)} ELSE substr(raw, 1, 60) END AS title FROM (SELECT doc_id, raw, lower(raw) AS t FROM (SELECT doc_id, {sql_list(['Einreise', 'Studium', 'Termine', 'x'])}[CAST(doc_id % 4 AS INTEGER) + 1] || ' ' || text AS raw FROM documents))",
)
def c14(spark, d):
    title = F.concat_ws(" ", A.pick(["Einreise", "Studium", "Termine", "x"], F.col("doc_id")), "text")
    return A.table(spark, d, "documents").select("doc_id", labels.office_title(title).alias("title"))


PAGE_NAMES = [p[0] for p in C.GUIDE_PAGES] + ["andere"]


@query(
    "C15_page_labels",
    "SELECT p_partkey, CASE name "
    + " ".join(f"WHEN {q(p[0])} THEN {q(p[1])}" for p in C.GUIDE_PAGES)
    + " ELSE '其他' END AS category, CASE name "
    + " ".join(f"WHEN {q(p[0])} THEN {q('|'.join(p[2]))}" for p in C.GUIDE_PAGES if p[2])
    + " ELSE name END AS tags, CASE name "
    + " ".join(f"WHEN {q(p[0])} THEN {q('|'.join(p[3]))}" for p in C.GUIDE_PAGES if p[3])
    + f" ELSE '新移民' END AS target_groups FROM (SELECT p_partkey, {sql_list(PAGE_NAMES)}[CAST(p_partkey % {len(PAGE_NAMES)} AS INTEGER) + 1] AS name FROM part)",
)
def c15(spark, d):
    row = labels.page_labels(A.pick(PAGE_NAMES, F.col("p_partkey")))
    return A.table(spark, d, "part").select("p_partkey", row.alias("r")).select("p_partkey", "r.*")


@query(
    "C16_run_log_metrics",
    with_roles(["logs"], """
SELECT run_id, coalesce(arg_min(v, line_no) FILTER (event_type = 'purchase'), 0) AS requests_used,
  coalesce(arg_min(v, line_no) FILTER (event_type = 'error' AND user_id % 3 = 0), count(*) FILTER (event_type = 'view')) AS flushed,
  count(*) FILTER (event_type = 'click') AS skipped, coalesce(bool_or(event_type = 'error' AND user_id % 3 <> 0), false) AS hit_usage_wall
FROM logs GROUP BY 1"""),
)
def c16(spark, d):
    return runs.run_log_metrics(A.log_lines(spark, d))


@query(
    "X3_text_and_list_defaults",
    with_roles(["jobs"], "SELECT refnr, coalesce(nullif(trim(title_zh), ''), title_de) AS title, coalesce(CASE WHEN len(tags) > 0 THEN array_to_string(tags, '|') END, 'keine') AS tags FROM jobs"),
)
def x3(spark, d):
    return A.jobs(spark, d).select(
        "refnr", text.text_or(F.concat(F.lit(" "), "title_zh", F.lit("\t")), F.col("title_de")).alias("title"),
        text.list_or(F.concat(F.array(F.lit(" ")), "tags"), F.array(F.lit("keine"))).alias("tags"),
    )


@query("X7_clean_text", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean_md5 FROM documents")
def x7(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"))


@query(
    "X8_normalize_date",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN '' WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""",
)
def x8(spark, d):
    t = F.col("o_orderdate")
    n = F.col("o_orderkey") % 6
    raw = (
        F.when(n == 0, F.concat(F.date_format(t, "d MMM yyyy"), F.lit(" 10:00:00 GMT")))
        .when(n == 1, F.date_format(t, "yyyy-MM-dd"))
        .when(n == 2, F.date_format(t, "dd.MM.yyyy"))
        .when(n == 3, F.concat(F.lit("Stand: "), F.date_format(t, "d.M.yyyy")))
        .when(n == 4, F.concat(F.lit("Wed, "), F.date_format(t, "dd MMM yyyy"), F.lit(" 23:30:00 +0000")))
        .otherwise("unbekannt")
    )
    return A.table(spark, d, "orders").select("o_orderkey", normalize_date(raw).alias("d"))


X11_VALUE = "c_name || ' ' || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' Größe & Übérgröße' WHEN 1 THEN ' Straße' ELSE '' END"


@query(
    "X11_feed_slug",
    f"""SELECT c_custkey, substr(trim(regexp_replace(replace(strip_accents(lower({X11_VALUE})), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 72) || '-' || substr(sha1({X11_VALUE}), 1, 8) AS slug FROM customer""",
)
def x11(spark, d):
    i = F.col("c_custkey") % 3
    tail = F.when(i == 0, " Größe & Übérgröße").when(i == 1, " Straße").otherwise("")
    return A.table(spark, d, "customer").select("c_custkey", keys.feed_slug(F.concat("c_name", F.lit(" "), "c_mktsegment", tail)).alias("slug"))


@query(
    "X12_page_slug",
    "SELECT page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) || '-' || substr(md5(url), 1, 6) AS slug FROM pages",
)
def x12(spark, d):
    return A.table(spark, d, "pages").select("page_id", keys.page_slug(F.col("url"), F.col("url")).alias("slug"))


@query(
    "X13_scrape_slug",
    """SELECT page_id, substr(regexp_replace(regexp_replace(lower(url || ' 中文'), '[^a-z0-9\\x{4e00}-\\x{9fff}\\s-]', '', 'g'), '\\s+', '-', 'g'), 1, 50) || '---' ||
  substr(replace(regexp_replace(url, 'https?://', ''), '/', '-'), 1, 30) || '---' || substr(md5(url), 1, 8) AS slug FROM pages""",
)
def x13(spark, d):
    return A.table(spark, d, "pages").select("page_id", keys.scrape_slug(F.concat_ws(" ", "url", F.lit("中文")), F.col("url")).alias("slug"))


DIGITS36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((ms // {36 ** k}) % 36 AS INTEGER) + 1, 1)" for k in range(8, -1, -1))


@query(
    "X14_timed_slug",
    f"""SELECT o_orderkey, trim(regexp_replace(replace(lower(o_orderpriority || ' für'), 'ü', 'ue'), '[^a-z0-9]+', '-', 'g'), '-') || '-' || ltrim({DIGITS36}, '0') AS slug
FROM (SELECT *, epoch_ms(o_orderdate) AS ms FROM orders)""",
)
def x14(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return rows.select("o_orderkey", keys.timed_slug(F.concat_ws(" ", "o_orderpriority", F.lit("für")), F.col("o_orderdate")).alias("slug"))


@query(
    "X15_service_key",
    """SELECT page_id, CASE WHEN length(k) > 100 THEN substr(k, 1, 80) || '_' || substr(md5(u), 1, 8) ELSE k END AS service_key FROM (
  SELECT page_id, u, lower(trim(regexp_replace(regexp_replace('px_' || replace(replace(u, 'https://', ''), 'http://', ''), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS k
  FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/Sehr/Lang?' || repeat('Teil-', 20) ELSE url END AS u FROM pages))""",
)
def x15(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/Sehr/Lang?" + "Teil-" * 20))).otherwise(F.col("url"))
    return A.table(spark, d, "pages").select("page_id", keys.service_key(u, "px").alias("service_key"))


def entry_of(text):
    """Description of the first entry of a JSON text in any of the accepted shapes."""
    return F.coalesce(*[F.get_json_object(text, f"{p}.description_zh") for p in ("$", "$[0]", "$.results[0]")])


@query(
    "X17_json_object_text",
    with_roles(["replies"], """
SELECT refnr, turn, shape <> 6 AS found, CASE WHEN shape NOT IN (3, 6) THEN md5(text) END AS text_md5 FROM replies"""),
)
def x17(spark, d):
    found = replies.json_object_text(F.col("reply_text"))
    return A.model_replies(spark, d).select(
        "refnr", "turn", found.isNotNull().alias("found"), F.when(F.col("shape") != 3, F.md5(entry_of(found))).alias("text_md5")
    )


@query(
    "X18_fence_stripped",
    with_roles(["replies"], """
SELECT refnr, turn, shape = 0 AS was_fenced, false AS has_control, CASE WHEN shape NOT IN (3, 4, 6) THEN md5(text) END AS text_md5,
  CASE shape WHEN 6 THEN 'kein JSON: ' || role END AS plain FROM replies"""),
)
def x18(spark, d):
    t = replies.fence_stripped(F.col("reply_text"))
    shape = F.col("shape")
    return A.model_replies(spark, d).select(
        "refnr", "turn", (F.col("reply_text").contains("```") & ~t.contains("```")).alias("was_fenced"),
        t.rlike(replies.CONTROL).alias("has_control"), F.when(~shape.isin(3, 4, 6), F.md5(entry_of(t))).alias("text_md5"), F.when(shape == 6, t).alias("plain"),
    )


@query(
    "X19_reply_items",
    with_roles(["replies"], """
SELECT refnr, turn, 0 AS pos, title_zh, md5(text) AS text_md5 FROM replies WHERE shape IN (0, 1, 2, 3, 5)
UNION ALL SELECT refnr, turn, 1, title_zh, md5(text) FROM replies WHERE shape = 3"""),
)
def x19(spark, d):
    return parsed_replies(spark, d).select("key", "turn", "pos", "title_zh", F.md5("description_zh").alias("text_md5")).withColumnRenamed("key", "refnr")


def parsed_replies(spark, d):
    """Reply entries of the chat turns: ``refnr, description_zh, tags, title_zh`` with ``key, turn, pos``."""
    from pyspark.sql import types as T

    item = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("refnr", "description_zh", "title_zh")]
        + [T.StructField("tags", T.ArrayType(T.StringType()))]
    )
    rows = A.model_replies(spark, d).select(F.col("refnr").alias("key"), "turn", "reply_text")
    rows = text.computed(rows, {"u": replies.unwrap_text_block(F.col("reply_text"))})
    rows = text.computed(rows, {"t": replies.fence_stripped(F.col("u"))})
    return replies.reply_items(rows, "t", item).select("key", "turn", "pos", "item.*")


@query(
    "X20_normalisers",
    with_roles(["reviews"], f"""
SELECT id, CASE WHEN review_status IN ({', '.join(q(s) for s in C.REVIEW_STATUSES)}) THEN review_status ELSE 'uncertain' END AS review_status,
  CASE WHEN suggested_action IN ({', '.join(q(s) for s in C.REVIEW_ACTIONS)}) THEN suggested_action ELSE 'manual_check' END AS action,
  CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 0.0 ELSE least(greatest(floor(confidence * 10) / 10, 0), 1) END AS confidence FROM reviews"""),
)
def x20(spark, d):
    r = A.reviews(spark, d)
    shown = F.concat((F.floor(F.col("confidence") * 10) / 10).cast("string"), F.lit(" sicher"))
    raw = F.when(F.col("id").cast("bigint") % 10 == 0, "hoch").otherwise(shown)
    return r.select(
        "id", replies.normalize_review_status(F.col("review_status")).alias("review_status"),
        replies.normalize_action(F.col("suggested_action")).alias("action"), replies.normalize_confidence(raw).alias("confidence"),
    )


@query(
    "X21_length_caps",
    "SELECT doc_id, substr(text, 1, 100) AS title_zh, md5(substr(text, 1, 600)) AS summary_md5, '未查到' AS fees_zh, array_to_string(string_split(text, chr(10))[1:20], '|') AS steps_zh FROM documents",
)
def x21(spark, d):
    reply = F.struct(
        F.col("text").alias("title_zh"), F.col("text").alias("summary_zh"), F.split("text", "\n").alias("requirements_zh"),
        F.lit("").alias("fees_zh"), F.lit(None).cast("string").alias("duration_zh"), F.split("text", "\n").alias("steps_zh"),
    )
    out = A.table(spark, d, "documents").select("doc_id", *replies.policy_enrichment(reply))
    return out.select("doc_id", "title_zh", F.md5("summary_zh").alias("summary_md5"), "fees_zh", "steps_zh")


@query(
    "X21_job_fields",
    "SELECT doc_id, substr(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END, 1, 20) AS title_zh, coalesce(substr(CASE WHEN doc_id % 3 > 0 THEN text END, 1, 100), '') AS brief_zh FROM documents",
)
def x21_jobs(spark, d):
    i = F.col("doc_id")
    reply = F.struct(F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("title_zh"), F.when(i % 3 > 0, F.col("text")).alias("brief_zh"))
    return A.table(spark, d, "documents").select("doc_id", *replies.job_enrichment(reply))


@query("X22_detail_key", "SELECT c_custkey, to_base64(encode(c_name)) AS k FROM customer")
def x22(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", text.detail_key(F.col("c_name")).alias("k"))


@query(
    "X22_absolute_url",
    "SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/feed.xml' AS link FROM pages",
)
def x22_url(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.absolute_url(F.lit("/feed.xml"), F.col("url")).alias("link"))


@query("X23_escape_like", "SELECT page_id, replace(replace(replace(replace(url, '\\', '\\\\'), '%', '\\%'), '_', '\\_'), ',', ' ') AS escaped FROM pages")
def x23(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.escape_like_column(F.col("url")).alias("escaped"))
