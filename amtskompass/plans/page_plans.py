"""Page and feed extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.keys import content_hash, visible_text_hash
from ..functions.text import decode_entities, strip_cdata, strip_tags, text_parts
from ..operators import feeds, pages, queue, snapshots, stats
from ..sources import adapters as A
from ..streaming.latest import latest_clean
from .registry import query
from .roles_sql import any_of, first_rule, pick, q, with_roles

AS_OF = "2024-07-01 00:00:00"
STAMP = "'2024-07-01 00:00:00'"
STAMP_OLD = "'2024-01-05 00:00:00'"


def decoded(expr: str) -> str:
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        expr = f"replace({expr}, '{entity}', '{plain}')"
    return expr


def readable(expr: str) -> str:
    for tag in ("script", "style", "nav", "footer"):
        expr = f"regexp_replace({expr}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    return f"trim(regexp_replace({decoded(f'regexp_replace({expr}, $$<[^>]*>$$, $$ $$, $$g$$)')}, '\\s+', ' ', 'g'))"


def title(expr: str) -> str:
    h1 = f"regexp_extract({expr}, '(?i)<h1[^>]*>([^<]+)</h1>', 1)"
    cut = f"regexp_replace(regexp_extract({expr}, '(?i)<title[^>]*>([^<]+)</title>', 1), '\\s*[-|][^\\n\\r]*$', '')"
    return f"CASE WHEN {h1} <> '' THEN trim({h1}) ELSE trim({cut}) END"


def content(expr: str) -> str:
    found = f"list_transform(regexp_extract_all({expr}, '(?i)<p[^>]*>([^<]{{50,}})</p>', 1), lambda p: trim(p, ' ' || chr(10)))"
    return (f"array_to_string(list_filter({found}, lambda p: NOT regexp_matches(p, '(?i)cookie|datenschutz|impressum|©')),"
            " chr(10) || chr(10))")


@query("H1_readable_text", f"SELECT page_id, md5({readable('html')}) AS text_md5, length({readable('html')}) AS n FROM pages")
def h1(spark, d):
    out = pages.readable_text(A.table(spark, d, "pages"))
    return out.select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


@query(
    "H2_basic_page",
    f"SELECT page_id, {title('html')} AS title, md5({content('html')}) AS content_md5, regexp_extract(html, '\\b(\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS published_date FROM pages",
)
def h2(spark, d):
    return pages.basic_page(A.table(spark, d, "pages")).select("page_id", "title", F.md5("content").alias("content_md5"), "published_date")


ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
PARAGRAPHS = f"list_transform(string_split({ARTICLE}, '<p>')[2:], lambda x: {decoded("regexp_replace(regexp_replace(x, '(?s)</p>.*', ''), '<[^>]*>', '', 'g')")})"
HEADING = decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


def squeezed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def key_sql(prefix: str) -> str:
    key = f"lower(trim(regexp_replace(regexp_replace('{prefix}_' || replace(replace(url, 'https://', ''), 'http://', ''), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'))"
    return f"CASE WHEN length({key}) > 100 THEN substr({key}, 1, 80) || '_' || substr(md5(url), 1, 8) ELSE {key} END"


def slug_sql(name: str) -> str:
    return f"substr(trim(regexp_replace(lower(trim({name})), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) || '-' || substr(md5(url), 1, 6)"


def guide_sql(cfg: pages.GuideConfig) -> str:
    """Pages of the given table are one heading and its paragraphs, so a guide is their filtered texts."""
    keep = ["length(x) >= 5"]
    if cfg.boilerplate:
        keep.append("NOT (" + " OR ".join(f"regexp_matches(x, '{b}')" for b in cfg.boilerplate) + ")")
    if cfg.nav_words:
        keep.append(f"NOT (length(x) < {cfg.nav_max} AND lower(x) IN ({', '.join(repr(w) for w in cfg.nav_words)}))")
    keep += [f"NOT contains(lower(x), '{w}')" for w in cfg.block_words]
    parts = f"list_filter(list_transform({PARAGRAPHS}, lambda x: {squeezed('x')}), lambda x: {' AND '.join(keep)})"
    whole = squeezed(decoded(f"regexp_replace({ARTICLE}, '<[^>]*>', '', 'g')"))
    return f"""SELECT {key_sql(cfg.prefix)} AS service_key, {slug_sql('t')} AS slug, t AS title_de, t AS title_zh, md5(body) AS summary_md5, url AS source_url FROM (
  SELECT url, t, CASE WHEN len(p) >= {cfg.min_parts} THEN array_to_string(p, chr(10) || chr(10)) WHEN length(w) > 10 THEN w ELSE '' END AS body
  FROM (SELECT url, coalesce(nullif({squeezed(HEADING)}, ''), '{cfg.title_default}') AS t, {parts} AS p, {whole} AS w FROM pages)) WHERE length(body) >= {cfg.min_length}"""


def publisher_pages(spark, d, before: str, behind: str):
    """Pages with the article in the element that a publisher's configuration looks for."""
    html = F.replace(F.replace("html", F.lit("<article>"), F.lit(before)), F.lit("</article>"), F.lit(behind))
    return A.table(spark, d, "pages").select("page_id", "url", html.alias("html"))


def guides(spark, d, cfg: pages.GuideConfig, before: str = "<main>", behind: str = "</main>"):
    found = pages.extract_guides(publisher_pages(spark, d, before, behind), cfg)
    return found.withColumn("summary_md5", F.md5("summary_zh")).drop("summary_zh")


LOCAL_GUIDES = pages.GuideConfig(prefix="site", root=["article"], min_parts=3, title_within=["article"])


@query("H3_extract_guides", guide_sql(LOCAL_GUIDES))
def h3(spark, d):
    return guides(spark, d, LOCAL_GUIDES, "<article>", "</article>")


@query("H3_migration_office", guide_sql(pages.MIGRATION_OFFICE))
def h3_migration(spark, d):
    return guides(spark, d, pages.MIGRATION_OFFICE, '<div id="content"><div class="column">', "</div></div>")


@query("H3_foreign_office", guide_sql(pages.FOREIGN_OFFICE))
def h3_foreign(spark, d):
    return guides(spark, d, pages.FOREIGN_OFFICE)


NODES = f"list_transform(regexp_split_to_array({ARTICLE}, '<[^>]*>'), lambda x: {decoded('x')})"

PAGE_NAMES = ["", *[p[0] for p in C.GUIDE_PAGES], "unbekannt"]
PAGE_NAME = pick(PAGE_NAMES, "CAST(regexp_extract(url, '([0-9]*)$', 1) || '0' AS BIGINT) // 10 + length(url)")


def by_name(field: int, default: str) -> str:
    value = lambda p: q(p[field] if field == 1 else "|".join(p[field]))
    return "CASE name " + " ".join(f"WHEN {q(p[0])} THEN {value(p)}" for p in C.GUIDE_PAGES if p[field]) + f" ELSE {default} END"


@query(
    "H3_consumer_guide",
    f"""SELECT g.* REPLACE (CASE WHEN name <> '' THEN name ELSE slug END AS slug), {by_name(1, q(C.OTHER_CATEGORY))} AS category, {by_name(2, 'name')} AS tags,
  {by_name(3, q('|'.join(C.GUIDE_PAGE_DEFAULT_GROUPS)))} AS target_groups, '' AS requirements_zh, '' AS fees_zh, '' AS duration_zh, '' AS steps_zh
FROM (SELECT g.*, {PAGE_NAME.replace('url', 'source_url')} AS name FROM ({guide_sql(pages.CONSUMER_GUIDE)}) g) g""".replace("SELECT g.* REPLACE", "SELECT g.* EXCLUDE (name) REPLACE"),
)
def h3_consumer(spark, d):
    """Guides of a source that lists its pages by name."""
    number = F.floor(F.concat(F.regexp_extract("url", "([0-9]*)$", 1), F.lit("0")).cast("bigint") / 10) + F.length("url")
    listed = publisher_pages(spark, d, "<main>", "</main>").withColumn("page_name", A.pick(PAGE_NAMES, number))
    found = pages.extract_guides(listed, pages.CONSUMER_GUIDE, name="page_name")
    return found.withColumn("summary_md5", F.md5("summary_zh")).drop("summary_zh")


EXCHANGE_TEXT = f"array_to_string(list_filter(list_transform({NODES}, lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: true), chr(10))"
EXCHANGE_CLEAN = squeezed(EXCHANGE_TEXT)
for _phrase in C.EXCHANGE_NOISE_PHRASES:
    EXCHANGE_CLEAN = f"replace({EXCHANGE_CLEAN}, {q(_phrase)}, '')"
VISIBLE = "html"
for _tag in ("script", "style", "noscript"):
    VISIBLE = f"regexp_replace({VISIBLE}, '(?is)<{_tag}\\b.*?</{_tag}>', '', 'g')"
VISIBLE = f"regexp_replace({VISIBLE}, '(?s)<!--.*?-->', '', 'g')"


@query(
    "H3_extract_exchange_pages",
    f"""SELECT {key_sql('daad')} AS service_key, {slug_sql('t')} AS slug, t AS title_de, t AS title_zh, md5(CASE WHEN length(body) >= 50 THEN body ELSE '' END) AS summary_md5, url AS source_url,
  md5(array_to_string(list_transform(regexp_split_to_array(regexp_replace(replace(replace({VISIBLE}, '<article>', '<main>'), '</article>', '</main>'), '<[^>]*>', '<>', 'g'), '<>'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '')) AS content_hash,
  {', '.join(f'{q(v)} AS {k}' for k, v in C.EXCHANGE_SOURCE.items())}, {q('|'.join(C.EXCHANGE_TAGS))} AS tags, false AS translated, {STAMP} AS last_fetched_at
FROM (SELECT url, html, CASE WHEN contains(lower({HEADING}), 'cookie') OR contains(lower({HEADING}), 'einwilligung') OR trim({HEADING}) = '' THEN coalesce(nullif(string_split(url, '/')[-2], ''), 'DAAD Page') ELSE trim({HEADING}) END AS t,
  {squeezed(EXCHANGE_CLEAN)} AS body FROM pages)""",
)
def h3_exchange(spark, d):
    found = pages.extract_exchange_pages(publisher_pages(spark, d, "<main>", "</main>"), fetched_at=AS_OF)
    return found.withColumn("summary_md5", F.md5("summary_zh")).drop("summary_zh")


LINES = f"list_filter(list_transform(flatten(list_transform({NODES}, lambda x: string_split(x, chr(10)))), lambda x: trim(x, ' ' || chr(9))), lambda x: length(x) > 15)"
CONTACT = " OR ".join(f"contains(lower(x), '{w}')" for w in C.CONTACT_NEEDLES)
FEES_ASCII = "(?i)([0-9]+[.,]?[0-9]*)\\s*(€|euro|eur)|gebühren?pflichtig|gebühren?|kostenlos"
DAYS_ASCII = "(?i)([0-9]+)\\s*(woche|monat|tag|jahr|wochen|monaten|tagen|jahren)|bearbeitungszeit|dauer"


@query(
    "H4_office_pages",
    f"""SELECT 'berlin_lea_' || substr(regexp_replace(lower(t), '[^a-z0-9]', '_', 'g'), 1, 40) AS service_key, {slug_sql("'berlin-lea-' || t")} AS slug,
  'Berlin LEA — ' || t AS title_de, substr(coalesce(list_filter(l, lambda x: regexp_matches(x, '{FEES_ASCII}'))[1], ''), 1, 150) AS fees_zh,
  substr(coalesce(list_filter(l, lambda x: regexp_matches(x, '{DAYS_ASCII}'))[1], ''), 1, 150) AS duration_zh, md5(array_to_string(list_filter(l, lambda x: {CONTACT}), chr(10))) AS contact_md5,
  '' AS requirements_zh, '' AS steps_zh, {q(C.OFFICE_SOURCE['publisher'])} AS publisher, {q(C.OFFICE_SOURCE['source_name'])} AS source_name,
  '居留与签证' AS category, url AS source_url, '市' AS region_level, 'Berlin' AS region_name, false AS translated
FROM (SELECT url, coalesce(nullif(trim({HEADING}), ''), 'Berlin LEA') AS t, {LINES} AS l FROM pages)""",
)
def h4(spark, d):
    found = pages.office_page(A.table(spark, d, "pages"), pages.CAPITAL_OFFICE)
    return found.select(
        "service_key", "slug", "title_de", "fees_zh", "duration_zh", F.md5("contact_info").alias("contact_md5"), "requirements_zh", "steps_zh",
        "publisher", "source_name", "category", "source_url", "region_level", "region_name", "translated"
    )


OFFICE_NAME = first_rule("lower(t)", [(label, [needle]) for needle, label in C.OFFICE_TITLES], "substr(t, 1, 60)")
OFFICE_TOPIC = first_rule("lower(t) || ' ' || lower(url)", C.OFFICE_TOPIC_RULES, q(C.OFFICE_TOPIC_DEFAULT))


def sql_text(template: str, **values: str) -> str:
    """SQL of a text template."""
    parts = [values[name] if name else q(text) for text, name in text_parts(template)]
    return " || ".join(parts)


@query(
    "H4_office_labels",
    f"""SELECT url AS source_url, {q(C.OFFICE_SOURCE['title_prefix_zh'])} || n AS title_zh, {sql_text(C.OFFICE_SUMMARY, office=q(C.OFFICE_SOURCE['office_zh']), topic_name='n', title='t')} AS summary_zh,
  concat_ws('|', {q(C.OFFICE_SOURCE['office_zh'])}, {q(C.OFFICE_SOURCE['default_title'])}, {q(C.OFFICE_PERMIT_TAG)}, 'Berlin', {OFFICE_TOPIC}) AS tags
FROM (SELECT *, {OFFICE_NAME} AS n FROM (SELECT url, coalesce(nullif(trim({HEADING}), ''), 'Berlin LEA') AS t FROM pages))""",
)
def h4_labels(spark, d):
    """Labels of the office pages: name, topic and texts made of them (the rules have queries with SQL of their own)."""
    return pages.office_page(A.table(spark, d, "pages"), pages.CAPITAL_OFFICE).select("source_url", "title_zh", "summary_zh", "tags")


KEYS = [e[0] for e in C.KEYED_OFFICE_PAGES]


def of_key(field: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(url, {q(e[0])}) THEN {q(e[field])}" for e in C.KEYED_OFFICE_PAGES) + f" ELSE {q(C.KEYED_OFFICE_PAGES[0][field])} END"


KEYED = {"key": "k", "name": "n", "topic": "topic", "title": "t"}


@query(
    "H4_keyed_office_pages",
    f"""SELECT {', '.join(f'{sql_text(C.KEYED_OFFICE[f], **KEYED)} AS {f}' for f in C.KEYED_OFFICE if f != 'slug_title')},
  {slug_sql(sql_text(C.KEYED_OFFICE['slug_title'], **KEYED))} AS slug, topic AS category, concat_ws('|', {', '.join(sql_text(t, **KEYED) for t in C.KEYED_OFFICE_TAGS)}) AS tags, url AS source_url, false AS translated
FROM (SELECT url, {of_key(0)} AS k, {of_key(2)} AS n, {of_key(3)} AS topic, coalesce(nullif(trim({HEADING}), ''), {of_key(1)}) AS t
  FROM (SELECT html, url || '/' || {pick(['x', *KEYS], 'page_id')} AS url FROM pages))""",
)
def h4_keyed(spark, d):
    """Office pages below addresses that hold the known keys, or none of them."""
    rows = A.table(spark, d, "pages").withColumn("url", F.concat("url", F.lit("/"), A.pick(["x", *KEYS], F.col("page_id"))))
    return pages.keyed_office_page(rows)


BLANKS = "[\\s\\x{A0}]*"  # no-break spaces too
FEE_SQL = f"(?i)([0-9]+[.,]?[0-9]*){BLANKS}(€|euro|eur)|gebühren?pflichtig|gebühren?|kostenlos".replace("\\\\", "\\")
DURATION_SQL = f"(?i)([0-9]+){BLANKS}(woche|monat|tag|jahr|wochen|monaten|tagen|jahren)|bearbeitungszeit|dauer".replace("\\\\", "\\")
LINED = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'zahlt ' || doc_id || chr(160) || '€ im Amt' || chr(10) WHEN 1 THEN 'DIE GEBÜHREN ' || doc_id || chr(10)
  WHEN 2 THEN 'nach ' || doc_id || chr(160) || 'WOCHEN' || chr(10) ELSE '' END || text AS text FROM documents)"""


def lined(spark, d):
    """Documents with a first line that has a no-break space or capital umlauts."""
    i = F.col("doc_id").cast("string")
    first = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("zahlt "), i, F.lit(" € im Amt\n")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("DIE GEBÜHREN "), i, F.lit("\n")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("nach "), i, F.lit(" WOCHEN\n")))
        .otherwise("")
    )
    return A.table(spark, d, "documents").select("doc_id", F.concat(first, "text").alias("text"))


@query(
    "H5_first_matching_line",
    f"""SELECT doc_id, coalesce(substr(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{FEE_SQL}'))[1], 1, 150), '') AS fee_line,
  coalesce(substr(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{DURATION_SQL}'))[1], 1, 150), '') AS duration_line,
  coalesce(substr(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)eur|de la|[0-9]+'))[1], 1, 150), '') AS other_line FROM {LINED}""",
)
def h5(spark, d):
    lines = F.split("text", "\n")
    return lined(spark, d).select(
        "doc_id",
        pages.first_matching_line(lines, C.FEE_PATTERNS).alias("fee_line"),
        pages.first_matching_line(lines, C.DURATION_PATTERNS).alias("duration_line"),
        pages.first_matching_line(lines, ["eur", "de la", "[0-9]+"]).alias("other_line"),
    )


TRIMMED = f"list_transform({PARAGRAPHS}, lambda x: trim(x, ' ' || chr(10)))"


@query(
    "H6_news_pages",
    f"""SELECT page_id, trim({HEADING}) AS news_title, '' AS news_subtitle, '' AS news_date,
  array_to_string(list_filter({TRIMMED}, lambda x: length(x) > 50 AND NOT contains(x, 'cookie') AND NOT contains(x, 'Datenschutz')), '|') AS paragraphs FROM pages""",
)
def h6(spark, d):
    return pages.news_page(A.table(spark, d, "pages")).select("page_id", "news_title", "news_subtitle", "news_date", "paragraphs")


@query(
    "H6_news_pages_static",
    f"""SELECT page_id, trim({HEADING}) AS news_title, regexp_extract(html, '(\\d{{1,2}}[./]\\d{{1,2}}[./]\\d{{2,4}})', 1) AS news_date,
  array_to_string(list_filter({TRIMMED}, lambda x: length(x) > 30), '|') AS paragraphs FROM pages""",
)
def h6_static(spark, d):
    return pages.news_page(A.table(spark, d, "pages"), static=True).select("page_id", "news_title", "news_date", "paragraphs")


@query(
    "H7_page_links",
    """SELECT page_id, unnest(h) AS raw, generate_subscripts(h, 1) - 1 AS pos, trim(unnest(t)) AS link_text, trim(unnest(t)) AS link_title FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"#][^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"#][^"]*)">([^<]*)</a>', 2) AS t FROM pages)""",
)
def h7(spark, d):
    links = pages.page_links(A.table(spark, d, "pages"), resolve=False)
    return links.select("page_id", F.col("link_url").alias("raw"), "pos", "link_text", "link_title")


@query(
    "H7_distinct_links",
    """SELECT page_id, link_url, min(pos) AS pos, arg_min(txt, pos) AS link_text FROM (
  SELECT page_id, origin || unnest(h) AS link_url, trim(unnest(t)) AS txt, generate_subscripts(h, 1) - 1 AS pos FROM (
    SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)) GROUP BY 1, 2""",
)
def h7_distinct(spark, d):
    return pages.distinct_links(pages.page_links(A.table(spark, d, "pages")), "page_id")


@query(
    "H8_parse_feed",
    with_roles(["feed_lines", "feed_items"], "SELECT source_id, doc_id, pos, md5(title) AS title_md5, link, md5(description) AS description_md5, published_at FROM feed_items"),
)
def h8(spark, d):
    items = feeds.parse_feed(A.feed_fetches(spark, d))
    return items.select(
        "source_id", "doc_id", "pos", F.md5("title").alias("title_md5"), "link", F.md5("description").alias("description_md5"), "published_at"
    )


@query(
    "H9_feed_health",
    """SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR doc_id % 8 < 2 THEN 0 ELSE len(string_split(text, chr(10))) END AS item_count,
  doc_id % 9 <> 0 AND doc_id % 8 >= 2 AS ok,
  CASE WHEN doc_id % 9 = 0 THEN 'Fetch failed 500 for https://' || source || '.example/rss/' || doc_id WHEN doc_id % 8 = 0 THEN 'URL did not return RSS/Atom content.'
    WHEN doc_id % 8 = 1 THEN 'Feed had no items.' ELSE '' END AS probe_error, doc_id % 9 <> 0 AND doc_id % 8 > 0 AS reachable FROM documents""",
)
def h9(spark, d):
    return feeds.feed_health(A.feed_fetches(spark, d)).select("doc_id", "item_count", "ok", "probe_error", "reachable")


def homepages(spark, d):
    """Pages that announce feeds: typed links in both attribute orders, one plain link."""
    i = F.col("page_id")
    tag = F.when(i % 3 == 0, '<link type="application/rss+xml" href="/a.xml">').when(
        i % 3 == 1, "<link href='b.xml' rel=alternate type='application/atom+xml'>"
    ).otherwise("")
    anchor = F.when(i % 2 == 0, '<a href="https://other.example/x/RSS?id=1">Abo</a>').otherwise("")
    return A.table(spark, d, "pages").select("page_id", "url", F.concat(tag, anchor, "html").alias("body"))


@query(
    "H10_discover_feeds",
    """WITH c AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS dir, url FROM pages),
t AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN origin || '/a.xml' WHEN page_id % 3 = 1 THEN CASE WHEN dir = '' OR dir LIKE '%://' THEN origin || '/' ELSE dir END || 'b.xml' END AS candidate FROM c)
SELECT page_id, candidate FROM t WHERE candidate IS NOT NULL
UNION ALL SELECT page_id, 'https://other.example/x/RSS?id=1' FROM pages WHERE page_id % 2 = 0""",
)
def h10(spark, d):
    return feeds.discover_feeds(homepages(spark, d)).select("page_id", "candidate")


RELEVANT = f"NOT {any_of('t', C.FEED_EXCLUDED)} AND {any_of('t', C.FEED_KEYWORDS)}"


@query(
    "F17_feed_relevance",
    f"SELECT doc_id, ({RELEVANT}) AS relevant FROM (SELECT doc_id, lower(concat_ws(' ', 'Antrag', text)) AS t FROM documents)",
)
def f17(spark, d):
    return A.table(spark, d, "documents").select("doc_id", feeds.policy_relevant(F.lit("Antrag"), F.col("text")).alias("relevant"))


@query(
    "F18_since_keeps_undated",
    with_roles(["feed_lines", "feed_items"], "SELECT link FROM feed_items WHERE published_at = '' OR published_at >= '2026-04-22'"),
)
def f18(spark, d):
    from ..functions.dates import since

    return feeds.parse_feed(A.feed_fetches(spark, d)).where(since(F.col("published_at"), "2026-04-22")).select("link")


@query(
    "F19_guide_url",
    f"SELECT page_id, NOT {any_of('url', C.GUIDE_URL_SKIPS)} AND NOT {any_of('html', C.GUIDE_URL_SKIPS)} AS keep FROM pages",
)
def f19(spark, d):
    return A.table(spark, d, "pages").select("page_id", (pages.guide_url(F.col("url")) & pages.guide_url(F.col("html"))).alias("keep"))


def kept_sql(cfg: pages.GuideConfig) -> str:
    keep = ["length(x) >= 5"]
    keep += ["NOT (" + " OR ".join(f"regexp_matches(x, '{b}')" for b in cfg.boilerplate) + ")"] if cfg.boilerplate else []
    keep += [f"NOT (length(x) < {cfg.nav_max} AND lower(x) IN ({', '.join(repr(w) for w in cfg.nav_words)}))"] if cfg.nav_words else []
    keep += [f"NOT contains(lower(x), '{w}')" for w in cfg.block_words]
    return f"list_filter(l, lambda x: {' AND '.join(keep)})"


PUBLISHERS = {"migration": pages.MIGRATION_OFFICE, "foreign": pages.FOREIGN_OFFICE, "consumer": pages.CONSUMER_GUIDE}
# words of the documents, some of them replaced by navigation words, cookie notes and the like
NOISE = ["Teilen", "zurück", "Wir nutzen Cookies im Netz", "mehr dazu", "Facebook und mehr"]


@query(
    "F20_drop_boilerplate",
    f"""WITH t AS (SELECT doc_id, list_concat([{', '.join(repr(n) for n in NOISE)}], string_split(text, chr(10))) AS l FROM documents)
SELECT doc_id, {', '.join(f'md5(array_to_string({kept_sql(c)}, $$|$$)) AS {n}_md5' for n, c in PUBLISHERS.items())} FROM t""",
)
def f20(spark, d):
    lines = F.concat(F.array(*[F.lit(n) for n in NOISE]), F.split("text", "\n"))
    docs = A.table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    return docs.select("doc_id", *[F.md5(F.array_join(pages.drop_boilerplate(F.col("lines"), c), "|")).alias(f"{n}_md5") for n, c in PUBLISHERS.items()])


@query(
    "W2_take_per_source",
    with_roles(["feed_lines", "feed_items"], """
SELECT source_id, link FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos, link) AS rn FROM feed_items
  WHERE published_at = '' OR published_at >= '2026-04-22') WHERE rn <= 4"""),
)
def w2(spark, d):
    from ..functions.dates import since

    items = feeds.parse_feed(A.feed_fetches(spark, d)).where(since(F.col("published_at"), "2026-04-22"))
    return feeds.take_per_source(items, 4).select("source_id", "link")


@query(
    "W2_select_feed_items",
    with_roles(["feed_lines", "feed_items"], f"""
SELECT source_id, link FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos, link) AS rn FROM (
  SELECT *, lower(title || ' ' || description) AS t FROM feed_items WHERE (published_at = '' OR published_at >= '2026-04-22')
    AND link NOT IN (SELECT 'https://feed.example/' || doc_id || '/0' FROM labels)) WHERE {RELEVANT}) WHERE rn <= 4"""),
)
def w2_select(spark, d):
    known = A.table(spark, d, "labels").select(
        F.concat(F.lit("https://feed.example/"), F.col("doc_id").cast("string"), F.lit("/0")).alias("official_url")
    )
    return feeds.select_feed_items(feeds.parse_feed(A.feed_fetches(spark, d)), known, "2026-04-22", 4).select("source_id", "link")


@query(
    "H12_city_fee_guides",
    """SELECT 'municipal_hundesteuer_' || lower(n_name) AS service_key, 'Hundesteuer ' || n_name || ' — Anmeldung, Gebühren & Pflichten' AS title_de,
  n_name || '犬税指南 — 登记、费用与养犬义务' AS title_zh, '首犬：' || n || '€' || chr(10) || '额外犬只（第二只起）：' || (n * 2) || '€' || chr(10) || '危险犬种可能有附加费，请向当地 Ordnungsamt 确认。' AS fees_zh,
  trim(regexp_replace('hundesteuer-' || lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(md5('https://city.example/' || n_name), 1, 6) AS slug, 'Stadt ' || n_name AS publisher
FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""",
)
def h12(spark, d):
    cities = (
        A.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
        .join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("name"), F.concat(F.col("n").cast("string"), F.lit("€")).alias("first"),
            F.concat((F.col("n") * 2).cast("string"), F.lit("€")).alias("extra"),
            F.concat(F.lit("https://city.example/"), "n_name").alias("url"),
        )
    )
    return pages.city_fee_guides(cities).select("service_key", "title_de", "title_zh", "fees_zh", "slug", "publisher")


@query(
    "H13_fill_defaults",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'Amt ' || source END AS publisher, 'Quelle ' || source AS source_name,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'cat-' || source END AS category, doc_id % 5 = 0 AS translated FROM documents""",
)
def h13(spark, d):
    i = F.col("doc_id")
    docs = A.table(spark, d, "documents")
    entries = docs.select(
        "doc_id", "source", F.when(i % 3 == 0, F.col("lang")).alias("publisher"), F.when(i % 4 == 0, "").alias("category"),
        F.when(i % 5 == 0, True).alias("translated"),
    )
    configs = docs.select("source").distinct().select(
        "source", F.concat(F.lit("Quelle "), "source").alias("source_name"), F.concat(F.lit("Amt "), "source").alias("publisher"),
        F.lit("州").alias("region_level"), F.lit("R").alias("region_name"), F.concat(F.lit("cat-"), "source").alias("category"),
    )
    return pages.fill_defaults(entries, configs, "source", AS_OF).select("doc_id", "publisher", "source_name", "category", "translated")


# --- snapshots ------------------------------------------------------------------------

FETCHED = ["fetches", "page_state"]


@query(
    "N1_etag_gate",
    with_roles(FETCHED, """
SELECT page_id, f.error IS NULL AND status = 200 AS changed, CASE WHEN f.error IS NULL AND status = 200 THEN f.etag ELSE s.etag END AS next_etag
FROM fetches f LEFT JOIN page_state s USING (url)"""),
)
def n1(spark, d):
    return snapshots.etag_gate(A.page_state(spark, d), A.fetches(spark, d)).select("page_id", "changed", "next_etag")


@query(
    "N2_save_etags",
    with_roles(FETCHED, """
SELECT coalesce(s.url, f.url) AS url, coalesce(f.etag, s.etag) AS etag FROM page_state s FULL JOIN (SELECT * FROM fetches WHERE status = 200 AND body <> '') f USING (url)"""),
)
def n2(spark, d):
    state = A.page_state(spark, d).select("url", "etag")
    return snapshots.save_etags(state, snapshots.stored_fetches(page_diff(spark, d, once=True)))


OUTCOME = "CASE WHEN error IS NOT NULL THEN 'network_error' WHEN status = 304 THEN 'not_modified' WHEN status <> 200 OR coalesce(body, '') = '' THEN 'http_error' ELSE 'parsed' END"


@query(
    "N3_classify_fetch",
    with_roles(["fetches"], f"""
SELECT page_id, {OUTCOME} AS outcome, CASE WHEN {OUTCOME} = 'parsed' THEN {title('body')} END AS title,
  CASE WHEN {OUTCOME} = 'parsed' THEN md5({content('body')}) END AS content_md5,
  {OUTCOME} = 'parsed' AND length({content('body')}) < 100 AS short FROM fetches"""),
)
def n3(spark, d):
    out = snapshots.classify_fetch(A.fetches(spark, d))
    return out.select("page_id", "outcome", "title", F.md5("content").alias("content_md5"), F.coalesce("short", F.lit(False)).alias("short"))


def page_diff(spark, d, once=False):
    """Diff of the fetches; with ``once`` a fetch stays one row even where its page is stored more than once."""
    old = pages.basic_page(A.page_state(spark, d)).select("service_key", content_hash(F.col("content")).alias("content_hash"))
    old = old.dropDuplicates(["service_key"]) if once else old
    return snapshots.diff_pages(old, snapshots.classify_fetch(A.fetches(spark, d)), AS_OF)


DIFF = with_roles(FETCHED, f""", old AS (SELECT service_key, md5({content('html')}) AS h FROM page_state),
new AS (SELECT *, {OUTCOME} AS outcome FROM fetches),
diff AS (SELECT n.service_key, n.url, n.outcome, CASE WHEN outcome = 'parsed' THEN md5({content('n.body')}) END AS new_hash,
  CASE WHEN outcome IN ('network_error', 'http_error') THEN 'error' WHEN outcome = 'not_modified' THEN 'skipped'
    WHEN o.h = md5({content('n.body')}) THEN 'skipped' WHEN o.service_key IS NOT NULL THEN 'updated' ELSE 'inserted' END AS action
  FROM new n LEFT JOIN old o USING (service_key))""")


@query("J4_diff_pages", DIFF + " SELECT service_key, action, new_hash FROM diff")
def j4(spark, d):
    return page_diff(spark, d).select("service_key", "action", "new_hash")


# stored pages before the diff, and what the sources say about the fetched ones
STORED = [
    ("id", "'id-' || service_key"), ("service_key", "service_key"), ("slug", "'slug-' || service_key"), ("title_zh", "'zh'"), ("title_de", "'de'"),
    ("summary_zh", "'sum'"), ("requirements_zh", "'a|b'"), ("fees_zh", "'1 Euro'"), ("duration_zh", "'2 Tage'"), ("steps_zh", "'c'"),
    ("region_level", "'Land'"), ("region_name", "'R'"), ("category", "'old'"), ("tags", "'t'"), ("publisher", "'P'"), ("source_url", "url"),
    ("source_name", "'S'"), ("translated", "true"), ("translated_at", STAMP_OLD), ("content_hash", "h"), ("last_fetched_at", STAMP_OLD),
    ("view_count", "7"), ("created_at", STAMP_OLD), ("updated_at", STAMP_OLD),
]


def stored_pages(spark, d):
    old = F.lit(STAMP_OLD.strip("'")).cast("timestamp")
    key, texts = F.col("service_key"), lambda *v: F.array(*[F.lit(x) for x in v])
    return pages.basic_page(A.page_state(spark, d)).select(
        F.concat(F.lit("id-"), key).alias("id"), key, F.concat(F.lit("slug-"), key).alias("slug"), F.lit("zh").alias("title_zh"),
        F.lit("de").alias("title_de"), F.lit("sum").alias("summary_zh"), texts("a", "b").alias("requirements_zh"), F.lit("1 Euro").alias("fees_zh"),
        F.lit("2 Tage").alias("duration_zh"), texts("c").alias("steps_zh"), F.lit("Land").alias("region_level"), F.lit("R").alias("region_name"),
        F.lit("old").alias("category"), texts("t").alias("tags"), F.lit("P").alias("publisher"), F.col("url").alias("source_url"),
        F.lit("S").alias("source_name"), F.lit(True).alias("translated"), old.alias("translated_at"),
        content_hash(F.col("content")).alias("content_hash"), old.alias("last_fetched_at"), F.lit(7).alias("view_count"),
        old.alias("created_at"), old.alias("updated_at"),
    )


def entry_diff(spark, d):
    i = F.col("page_id")
    new = snapshots.classify_fetch(A.fetches(spark, d)).withColumns({
        "category": F.when(i % 2 == 0, F.concat(F.lit("cat-"), i.cast("string"))), "tags": F.when(i % 3 == 0, F.array(F.lit("x"), F.lit("y"))),
        "publisher": F.concat(F.lit("Amt "), i.cast("string")), "region_name": F.when(i % 4 == 0, F.lit("Bund")),
    })
    return snapshots.diff_pages(stored_pages(spark, d), new, AS_OF)


# ids of inserted rows (a hash of the key) are compared by the key they are made of
APPLIED = DIFF + f""", stored AS (SELECT {', '.join(f'{v} AS {k}' for k, v in STORED)} FROM (SELECT o.h, s.* FROM old o JOIN page_state s USING (service_key))),
entries AS (SELECT d.*, page_id, {title('body')} AS title FROM diff d JOIN fetches f USING (service_key) WHERE d.outcome = 'parsed'),
applied AS (SELECT coalesce(o.service_key, x.service_key) AS service_key, coalesce(x.action IN ('inserted', 'updated'), false) AS w, x.action = 'inserted' AS fresh,
  coalesce(o.id, x.new_id) AS id, o.* EXCLUDE (id, service_key), x.* EXCLUDE (service_key) FROM stored o FULL JOIN (SELECT *, 'new ' || service_key AS new_id FROM entries) x USING (service_key))"""


@query(
    "N4_apply_diff",
    APPLIED + f""" SELECT id, service_key,
  CASE WHEN w THEN trim(substr(trim(regexp_replace(lower(coalesce(nullif(title, ''), service_key)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)) || '-' || substr(md5(url), 1, 6) ELSE slug END AS slug,
  CASE WHEN NOT w THEN title_zh END AS title_zh, CASE WHEN w THEN coalesce(nullif(title, ''), service_key) ELSE title_de END AS title_de, CASE WHEN NOT w THEN summary_zh END AS summary_zh,
  CASE WHEN w THEN '' ELSE requirements_zh END AS requirements_zh, CASE WHEN w THEN '' ELSE fees_zh END AS fees_zh, CASE WHEN w THEN '' ELSE duration_zh END AS duration_zh,
  CASE WHEN w THEN '' ELSE steps_zh END AS steps_zh, region_level, CASE WHEN w AND page_id % 4 = 0 THEN 'Bund' ELSE region_name END AS region_name,
  CASE WHEN w AND page_id % 2 = 0 THEN 'cat-' || page_id ELSE category END AS category,
  CASE WHEN w AND page_id % 3 = 0 THEN 'x|y' WHEN w THEN coalesce(tags, '') ELSE tags END AS tags, CASE WHEN w THEN 'Amt ' || page_id ELSE publisher END AS publisher,
  CASE WHEN w THEN url ELSE source_url END AS source_url, source_name, CASE WHEN w THEN false ELSE translated END AS translated,
  CASE WHEN NOT w THEN translated_at END AS translated_at, CASE WHEN w THEN new_hash ELSE content_hash END AS content_hash,
  CASE WHEN action IS NOT NULL THEN {STAMP} ELSE last_fetched_at END AS last_fetched_at, CASE WHEN fresh THEN 0 ELSE view_count END AS view_count,
  CASE WHEN fresh THEN {STAMP} ELSE created_at END AS created_at, CASE WHEN w THEN {STAMP} ELSE updated_at END AS updated_at FROM applied""",
)
def n4(spark, d):
    done = snapshots.apply_diff(stored_pages(spark, d), entry_diff(spark, d), AS_OF)
    return done.withColumn("id", F.when(F.col("id") == snapshots.page_id(F.col("service_key")), F.concat(F.lit("new "), "service_key")).otherwise(F.col("id")))


LATEST_TEXT = "Stand der Seite mit deutlich mehr als fuenfzig Zeichen im Absatz, Fassung "


@query(
    "N3_latest_clean",
    f"""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS service_key, ts, event_id % 3 AS v, CASE WHEN event_id % 4 > 0 THEN 'e' || event_id END AS etag FROM events WHERE event_type <> 'error'),
one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY service_key, ts ORDER BY etag NULLS LAST, md5('{LATEST_TEXT}' || v)) = 1),
seen AS (SELECT *, lag(v) OVER (PARTITION BY service_key ORDER BY ts) IS DISTINCT FROM v AS new FROM one)
SELECT service_key, 'T' || arg_max(v, ts) AS title, md5('{LATEST_TEXT}' || arg_max(v, ts)) AS new_hash, arg_max(etag, ts) FILTER (etag IS NOT NULL) AS etag, 'u/' || service_key AS url,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS fetched_at, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts) FILTER (new), '%Y-%m-%d %H:%M:%S') AS changed_at, true AS rewritten
FROM seen GROUP BY service_key""",
)
def n3_latest(spark, d):
    """Events as fetches of one page for each user: errors are timeouts, the others deliver one of three contents."""
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    version = (i % 3).cast("string")
    failed = F.col("event_type") == "error"
    fetched = A.table(spark, d, "events").select(
        user.alias("service_key"), F.concat(F.lit("u/"), user).alias("url"), F.when(i % 4 > 0, F.concat(F.lit("e"), i.cast("string"))).alias("etag"),
        F.when(~failed, F.concat(F.lit("<title>T"), version, F.lit(f"</title><p>{LATEST_TEXT}"), version, F.lit("</p>"))).alias("body"),
        F.when(failed, F.lit("timeout")).alias("error"), F.when(failed, 0).otherwise(200).alias("status"), F.col("ts").cast("timestamp").alias("fetched_at"),
    )
    return latest_clean(fetched)


@query(
    "N5_full_scrape",
    with_roles(["fetches"], "SELECT page_id, error IS NULL AND status = 200 AS changed, CASE WHEN error IS NULL AND status = 200 THEN etag END AS next_etag FROM fetches"),
)
def n5(spark, d):
    return snapshots.etag_gate(A.page_state(spark, d), A.fetches(spark, d), full=True).select("page_id", "changed", "next_etag")


@query(
    "A6_diff_summary",
    DIFF + """ SELECT count(*) AS processed, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated,
  count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'error') AS errors FROM diff""",
)
def a6(spark, d):
    return stats.diff_summary(page_diff(spark, d))


@query(
    "A6_scrape_summary",
    with_roles(["fetches"], """
SELECT count(*) AS fetched, count(*) FILTER (status = 200 AND coalesce(body, '') <> '') AS changed,
  count(*) FILTER (status = 200 AND contains(body, '<article>')) AS written, count(*) FILTER (status <> 200) AS skipped FROM fetches"""),
)
def a6_scrape(spark, d):
    gated = snapshots.etag_gate(A.page_state(spark, d), A.fetches(spark, d))
    return stats.scrape_summary(gated, F.col("body").contains("<article>"))


@query(
    "Q1_enqueue_changes",
    APPLIED + f""" SELECT 'policy' AS source_type, id AS source_id, url AS source_url, CASE WHEN action = 'updated' THEN 1 ELSE 0 END AS priority,
  0 AS attempts, 3 AS max_attempts, 'pending' AS status, CAST(NULL AS VARCHAR) AS error_message, {STAMP} AS created_at, CAST(NULL AS VARCHAR) AS processed_at FROM applied WHERE w""",
)
def q1(spark, d):
    diff = entry_diff(spark, d)
    named = diff.withColumn("target_id", F.when(F.col("action") == "inserted", F.concat(F.lit("new "), "service_key")).otherwise(F.col("target_id")))
    return snapshots.enqueue_changes(named, AS_OF).drop("id")


@query(
    "Q1_items_resolve",
    APPLIED + " SELECT coalesce(nullif(title, ''), service_key) AS title, true AS found, CAST(NULL AS VARCHAR) AS error FROM applied WHERE w",
)
def q1_resolves(spark, d):
    """Every item the diff puts into the queue finds its row in the stored table."""
    diff = entry_diff(spark, d)
    stored = snapshots.apply_diff(stored_pages(spark, d), diff, AS_OF)
    none = stored.limit(0).select(F.col("id").alias("refnr"), "title_de", F.lit("").alias("description_de"))
    return queue.resolve_queue(snapshots.enqueue_changes(diff, AS_OF), stored, none).select("title", "found", "error")


@query(
    "J4_change_in_paragraph_25",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM pages",
)
def j4_deep(spark, d):
    """Pages that differ in their 25th paragraph alone count as changed."""
    i = F.col("page_id")
    deep = F.concat(F.lit(("<p>" + "w" * 60 + "</p>") * 24), F.lit("<p>"), F.repeat(F.lit("x"), F.lit(60)))
    base = A.table(spark, d, "pages").select("page_id", F.concat(F.lit("k"), i.cast("string")).alias("service_key"), "url")
    old = pages.basic_page(base.withColumn("html", F.concat(deep, F.lit("</p>")))).select("service_key", content_hash(F.col("content")).alias("content_hash"))
    new = base.select(
        "page_id", "service_key", "url", F.lit(200).alias("status"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("error"),
        F.concat(deep, F.when(i % 2 == 0, "new</p>").otherwise("</p>")).alias("body"),
    )
    return snapshots.diff_pages(old, snapshots.classify_fetch(new), AS_OF).select("page_id", "action")


@query(
    "X5_strip_tags",
    "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS plain_md5, regexp_replace(regexp_replace('<![CDATA[' || url || ']]>', '^<!\\[CDATA\\[', ''), '\\]\\]>$', '') AS cdata FROM pages",
)
def x5(spark, d):
    return A.table(spark, d, "pages").select(
        "page_id", F.md5(strip_tags(F.col("html"))).alias("plain_md5"),
        strip_cdata(F.concat(F.lit("<![CDATA["), "url", F.lit("]]>"))).alias("cdata"),
    )


@query("X6_decode_entities", f"SELECT page_id, md5({decoded('html')}) AS decoded_md5 FROM pages")
def x6(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.md5(decode_entities(F.col("html"))).alias("decoded_md5"))


@query(
    "X16_content_hashes",
    f"""SELECT page_id, md5({content('html')}) AS paragraph_md5, md5(html) AS raw_md5, sha256({readable('html')}) AS readable_sha,
  md5(array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'),
    '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<noscript\\b.*?</noscript>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>'), lambda p: trim(p, ' ' || chr(10) || chr(9))), '')) AS visible_md5 FROM pages""",
)
def x16(spark, d):
    html = F.col("html")
    return pages.basic_page(A.table(spark, d, "pages")).select(
        "page_id", content_hash(F.col("content")).alias("paragraph_md5"), content_hash(html).alias("raw_md5"),
        content_hash(pages.readable(html), "sha256").alias("readable_sha"), visible_text_hash(html).alias("visible_md5"),
    )
