"""Page extraction jobs over fetched pages ``(url, html, ...)``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.html import TEXT, Selectors, element_text, step_pattern, under, within
from ..functions.keys import page_slug, service_key, visible_text_hash
from ..functions.labels import keyed_office, office_title, office_topic, page_labels
from ..functions.text import (
    SPACE, absolute_url, clean_text, computed, contains_any, decode_entities, fill, strip_tags, text_or, trim_all,
)
from .ranking import first_by

# --- native, regex based jobs -------------------------------------------------------


def readable(html: Column) -> Column:
    """Readable text: four block kinds dropped in order, tags to blanks, entities, single blanks."""
    for tag in ("script", "style", "nav", "footer"):
        html = F.regexp_replace(html, f"(?is)<{tag}.*?</{tag}>", " ")
    return clean_text(decode_entities(strip_tags(html)))


def readable_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    return pages.withColumn(out, readable(F.col(html)))


def page_title(html: Column) -> Column:
    """``<title>`` cut at its first dash or bar, overridden by a text-only ``<h1>``."""
    title = F.regexp_extract(html, "(?i)<title[^>]*>([^<]+)</title>", 1)
    cut = trim_all(F.regexp_replace(title, SPACE + r"*[-|][^\n\r\x{2028}\x{2029}]*\z", ""))
    h1 = F.regexp_extract(html, "(?i)<h1[^>]*>([^<]+)</h1>", 1)
    return F.when(h1 != "", trim_all(h1)).otherwise(cut)


def page_paragraphs(html: Column) -> Column:
    """Paragraphs without child tags and with at least 50 characters, minus legal boilerplate."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?i)<p[^>]*>([^<]{50,})</p>"), F.lit(1)), trim_all)
    return F.filter(found, lambda p: ~p.rlike("(?i)cookie|datenschutz|impressum|©"))


def basic_page(pages: DataFrame, html: str = "html", paragraphs: int | None = None) -> DataFrame:
    """Adds title, content (all paragraphs, or the first ``paragraphs`` for a preview) and the first date found."""
    source = F.col(html)
    texts = page_paragraphs(source) if paragraphs is None else F.slice(page_paragraphs(source), 1, paragraphs)
    return pages.withColumns(
        {
            "title": page_title(source),
            "content": F.array_join(texts, "\n\n"),
            "published_date": F.regexp_extract(
                source, r"\b(\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d{2}-\d{2})\b", 1
            ),
        }
    )


LINE_CHARS = 150  # stored format of fee and duration lines


def first_matching_line(lines: Column, patterns: list[str], most: int | None = LINE_CHARS) -> Column:
    """First line matching any pattern, letters of any case and all kinds of blanks; else empty.

    ``most`` characters of it are stored (None: all); matching always reads the whole line.
    """
    pattern = "(?iU)" + "|".join(patterns)
    hit = F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    return F.coalesce(hit if most is None else F.substring(hit, 1, most), F.lit(""))


def guide_url(url: Column) -> Column:
    """Addresses that are guides, not office administration."""
    return ~contains_any(url, C.GUIDE_URL_SKIPS)


# --- structured extraction ------------------------------------------------------------


@dataclass(frozen=True)
class GuideConfig:
    """How one publisher's pages are read.  Selectors: ``name``, ``#id``, ``.class`` or ``[role]``."""

    prefix: str
    root: list[str]
    column: str | None = None
    tags: list[str] = field(default_factory=lambda: ["h2", "h3", "h4", "p", "li"])
    boilerplate: list[str] = field(default_factory=list)
    containers: list[str] = field(default_factory=list)
    skip_ancestors: list[str] = field(default_factory=lambda: ["nav", "footer", "aside"])
    nav_words: list[str] = field(default_factory=list)
    nav_max: int = 0
    block_words: list[str] = field(default_factory=list)
    min_parts: int = 5
    min_length: int = 0
    title_within: list[str] = field(default_factory=list)
    title_last: bool = False
    title_cut: str | None = None
    title_default: str = "Untitled Page"


MIGRATION_OFFICE = GuideConfig(
    **C.GUIDE_SOURCES["migration"], boilerplate=C.MIGRATION_OFFICE_BOILERPLATE, containers=C.MIGRATION_OFFICE_CONTAINERS
)
FOREIGN_OFFICE = GuideConfig(**C.GUIDE_SOURCES["foreign"], boilerplate=C.FOREIGN_OFFICE_BOILERPLATE, nav_words=C.FOREIGN_OFFICE_NAV_WORDS)
CONSUMER_GUIDE = GuideConfig(**C.GUIDE_SOURCES["consumer"], nav_words=C.CONSUMER_NAV_WORDS, block_words=C.CONSUMER_BLOCK_WORDS)


def drop_boilerplate(parts: Column, cfg: GuideConfig) -> Column:
    """Parts (text array) without short pieces, boilerplate starts, navigation and blocked words."""

    def keep(text: Column) -> Column:
        good = F.length(text) >= 5
        if cfg.boilerplate:
            good = good & ~text.rlike("|".join(cfg.boilerplate))
        if cfg.nav_words:
            good = good & ~((F.length(text) < cfg.nav_max) & F.lower(text).isin(cfg.nav_words))
        if cfg.block_words:
            good = good & ~contains_any(F.lower(text), cfg.block_words)
        return good

    return F.filter(parts, keep)


def _tokenised(pages: DataFrame, html: str, selectors: Selectors = Selectors()) -> DataFrame:
    """Adds ``_tokens``, ``_texts`` and ``_roots`` of each page, parsed once."""
    rows = computed(pages, {"_page": selectors.page(F.col(html))})
    return rows.withColumns({f"_{c}": F.col(f"_page.{c}") for c in ("tokens", "texts", "roots")}).drop("_page")


def text_of(token: Column) -> Column:
    return element_text(token, F.col("_texts"))


def _texts(tokens: Column, tags: list[str]) -> Column:
    return F.filter(tokens, lambda t: t["tag"].isin(tags))


def _first_text(tokens: Column, tag: str, selectors: Selectors | None = None, inside: str | None = None) -> Column:
    hits = F.filter(tokens, lambda t: (t["tag"] == tag) & (selectors.inside(t, inside) if inside else F.lit(True)))
    return F.nullif(clean_text(text_of(F.get(hits, F.lit(0)))), F.lit(""))


def _guide_title(tokens: Column, cfg: GuideConfig, selectors: Selectors) -> Column:
    candidates = [_first_text(tokens, "h1", selectors, name) for name in cfg.title_within]
    if cfg.title_last:
        h1 = _texts(tokens, ["h1"])
        candidates.append(F.nullif(clean_text(text_of(F.try_element_at(h1, F.lit(-1)))), F.lit("")))
    if cfg.title_cut:
        head = _first_text(tokens, "title")
        candidates.append(trim_all(F.regexp_replace(head, cfg.title_cut, "")))
    return F.coalesce(*candidates, F.lit(cfg.title_default))


def _heading_span(tokens: Column, root: Column) -> Column:
    """Text of the first span directly below the root's first heading; null without one."""
    h1 = F.get(F.filter(tokens, lambda t: (t["tag"] == "h1") & under(t, root)), F.lit(0))
    spans = F.filter(tokens, lambda t: (t["tag"] == "span") & (t["parent"] == h1["i"]))
    return F.nullif(clean_text(text_of(F.get(spans, F.lit(0)))), F.lit(""))


def no_texts() -> Column:
    return F.array().cast("array<string>")


def extract_guides(pages: DataFrame, cfg: GuideConfig, html: str = "html", url: str = "url", name: str | None = None) -> DataFrame:
    """Guide rows ``service_key, slug, title_de, summary_zh, source_url``; unusable pages are left out.

    ``name`` is a column with the name a source's page list has for the page (null or empty: not listed).  Rows of such a
    source carry the name as their slug, the category, tags and groups of the named page, and the empty fields that the enrichment
    fills.  The tokeniser runs once per page; everything after it is native array work.
    """
    names = [*cfg.root, *([cfg.column] if cfg.column else []), *cfg.title_within, *cfg.skip_ancestors]
    boxes = {"furniture": rf"div.*\..*({'|'.join(cfg.containers)}).*|span.*\.aural.*"} if cfg.containers else {}
    selectors = Selectors(*dict.fromkeys(names), **boxes)
    tokens, roots = F.col("_tokens"), F.col("_roots")
    rows = computed(_tokenised(pages, html, selectors), {"_root": selectors.first_root(tokens, roots, *cfg.root)})
    rows = rows.where(F.col("_root").isNotNull())
    rows = computed(rows, {"_inner": F.filter("_tokens", lambda t: under(t, F.col("_root")))})
    column = F.coalesce(selectors.first_root(F.col("_inner"), roots, cfg.column), F.col("_root")) if cfg.column else F.col("_root")
    rows = computed(rows, {"_col": column})

    def usable(t: Column) -> Column:
        good = t["tag"].isin(cfg.tags) & under(t, F.col("_col"))
        for name in [*cfg.skip_ancestors, *boxes]:
            good = good & ~selectors.below(t, name)
        return good

    parts = drop_boilerplate(F.transform(F.filter("_inner", usable), lambda t: clean_text(text_of(t))), cfg)
    whole = clean_text(F.array_join(F.transform(F.filter("_inner", lambda t: t["tag"] == TEXT), text_of), ""))
    title = _guide_title(tokens, cfg, selectors)
    if cfg.column:
        title = F.coalesce(_heading_span(tokens, F.col("_root")), title)
    rows = computed(rows, {"_parts": parts, "_whole": whole, "title_de": title})
    fallback = F.when(F.length("_whole") > 10, F.col("_whole")).otherwise("")
    joined = F.array_join("_parts", "\n\n")
    rows = computed(rows, {"summary_zh": F.when(F.size("_parts") >= cfg.min_parts, joined).otherwise(fallback)})
    if cfg.min_length:
        rows = rows.where(F.length("summary_zh") >= cfg.min_length)
    source = F.col(url)
    slug = page_slug(F.col("title_de"), source)
    more = []
    if name:
        rows = rows.withColumn("_labels", page_labels(F.col(name)))
        slug = F.coalesce(F.nullif(F.col(name), F.lit("")), slug)
        more = [
            *[F.col(f"_labels.{c}").alias(c) for c in ("category", "tags", "target_groups")],
            no_texts().alias("requirements_zh"), F.lit("").alias("fees_zh"), F.lit("").alias("duration_zh"), no_texts().alias("steps_zh"),
        ]
    return rows.select(
        service_key(source, cfg.prefix).alias("service_key"),
        slug.alias("slug"),
        "title_de",
        F.col("title_de").alias("title_zh"),
        "summary_zh",
        source.alias("source_url"),
        *more,
    )


def extract_exchange_pages(pages: DataFrame, html: str = "html", url: str = "url", prefix: str = "daad",
                           fallback_title: Column | None = None, fallback_text: Column | None = None,
                           fetched_at: str | Column | None = None) -> DataFrame:
    """Study-service pages: cookie dialogs and noise phrases removed, text of the main element, with the facts of the source.

    ``fetched_at`` is the time of the fetch; ``content_hash`` covers the visible text of the whole page.
    """
    selectors = Selectors("main", "body", "article", ".qa-headline-title")
    rows = _tokenised(pages, html, selectors)
    tokens, inside = F.col("_tokens"), selectors.inside

    def clean_heading(text: Column) -> Column:
        text = F.nullif(trim_all(text), F.lit(""))
        return F.when(~contains_any(F.lower(text), ["cookie", "einwilligung"]), text)

    h1 = _texts(tokens, ["h1"])
    any_h1 = F.filter(h1, lambda t: clean_heading(text_of(t)).isNotNull())

    def first_h1(cond) -> Column:
        return clean_heading(text_of(F.get(F.filter(h1, cond), F.lit(0))))

    title = F.coalesce(
        first_h1(lambda t: inside(t, "main") & inside(t, ".qa-headline-title")),
        first_h1(lambda t: inside(t, "main")),
        first_h1(lambda t: inside(t, "article")),
        F.nullif(trim_all(text_of(F.get(any_h1, F.lit(0)))), F.lit("")),
        fallback_title if fallback_title is not None else F.lit(None).cast("string"),
        F.nullif(F.try_element_at(F.split(F.col(url), "/"), F.lit(-2)), F.lit("")),
        F.lit("DAAD Page"),
    )
    rows = computed(rows, {"_root": selectors.first_root(tokens, F.col("_roots"), "main", "body"), "title_de": title})
    dialogs = F.filter(
        "_tokens",
        lambda t: t["tag"].isin("dialog", "aside", "nav") & contains_any(F.lower(text_of(t)), ["cookie", "einwilligung"])
        & under(t, F.col("_root")),
    )
    rows = computed(rows, {"_cookie": F.transform(dialogs, lambda t: F.struct(t["i"].alias("i"), t["until"].alias("until")))})
    nodes = F.filter(
        "_tokens", lambda t: (t["tag"] == TEXT) & under(t, F.col("_root")) & ~F.exists("_cookie", lambda dialog: within(t, dialog))
    )
    text = clean_text(F.array_join(F.transform(nodes, lambda t: trim_all(text_of(t))), "\n"))
    text = F.replace(text, F.lit("­"), F.lit(""))
    for phrase in C.EXCHANGE_NOISE_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    rows = computed(rows, {"_text": clean_text(text)})
    backup = fallback_text if fallback_text is not None else F.lit("")
    source = F.col(url)
    return rows.select(
        service_key(source, prefix).alias("service_key"),
        page_slug(F.col("title_de"), source).alias("slug"),
        "title_de",
        F.col("title_de").alias("title_zh"),
        F.when(F.length("_text") >= 50, F.col("_text")).otherwise(backup).alias("summary_zh"),
        visible_text_hash(F.col(html)).alias("content_hash"),
        source.alias("source_url"),
        *[F.lit(C.EXCHANGE_SOURCE[c]).alias(c) for c in ENTRY_DEFAULTS],
        F.array(*[F.lit(t) for t in C.EXCHANGE_TAGS]).alias("tags"),
        F.lit(False).alias("translated"),
        (fetched_at if isinstance(fetched_at, Column) else F.lit(fetched_at)).cast("timestamp").alias("last_fetched_at"),
    )


@dataclass(frozen=True)
class OfficeConfig:
    """City office pages: names used in keys, titles, tags and texts."""

    city: str = C.OFFICE_SOURCE["city"]
    key_prefix: str = C.OFFICE_SOURCE["key_prefix"]
    slug_prefix: str = C.OFFICE_SOURCE["slug_prefix"]
    title_prefix: str = C.OFFICE_SOURCE["title_prefix"]
    title_prefix_zh: str = C.OFFICE_SOURCE["title_prefix_zh"]
    default_title: str = C.OFFICE_SOURCE["default_title"]
    office_zh: str = C.OFFICE_SOURCE["office_zh"]
    category: str = C.OFFICE_SOURCE["category"]
    region_level: str = C.OFFICE_SOURCE["region_level"]
    publisher: str = C.OFFICE_SOURCE["publisher"]
    source_name: str = C.OFFICE_SOURCE["source_name"]
    root: tuple[str, ...] = ("main", "[main]", "article")
    skip_classes: tuple[str, ...] = ("sidebar", "aside")
    contact_lines: int | None = None  # stored contact lines; None: all


CAPITAL_OFFICE = OfficeConfig()


# --- fixed values: elements that never hold office content ------------------------
OFFICE_SKIPPED = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe"]


def office_selectors(cfg: OfficeConfig) -> Selectors:
    """Roots of the content, and page furniture."""
    skipped = "|".join(step_pattern(t) for t in OFFICE_SKIPPED)
    return Selectors(*cfg.root, furniture=rf"{skipped}|[^@]*\.[^@]*({'|'.join(cfg.skip_classes)}).*")


def with_office_lines(rows: DataFrame, cfg: OfficeConfig) -> DataFrame:
    """Adds ``_lines``: content lines of more than 15 characters, outside page furniture."""
    selectors = office_selectors(cfg)
    rows = computed(rows, {"_kept": F.filter("_tokens", lambda t: (t["tag"] == TEXT) & ~selectors.inside(t, "furniture"))})
    rows = computed(rows, {"_root": selectors.first_root(F.col("_kept"), F.col("_roots"), *cfg.root)})
    nodes = F.filter("_kept", lambda t: F.col("_root").isNull() | under(t, F.col("_root")))
    lines = F.flatten(F.transform(nodes, lambda t: F.split(text_of(t), "\n")))
    lines = F.filter(F.transform(lines, trim_all), lambda x: F.length(x) > 15)
    return computed(rows, {"_lines": lines})


def office_page(pages: DataFrame, cfg: OfficeConfig = CAPITAL_OFFICE, html: str = "html", url: str = "url") -> DataFrame:
    """City office guides with topic, fee line, duration line and contact lines."""
    head = trim_all(text_of(F.get(_texts(F.col("_tokens"), ["h1"]), F.lit(0))))
    rows = computed(
        with_office_lines(_tokenised(pages, html, office_selectors(cfg)), cfg),
        {"title": F.coalesce(F.nullif(head, F.lit("")), F.lit(cfg.default_title))},
    )
    title, source = F.col("title"), F.col(url)
    content = F.col("_lines")
    contact = F.filter("_lines", lambda x: contains_any(F.lower(x), C.CONTACT_NEEDLES))
    topic = office_topic(title, source)
    name = office_title(title)
    return rows.select(
        F.concat(
            F.lit(cfg.key_prefix + "_"), F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", "_"), 1, 40)
        ).alias("service_key"),
        page_slug(F.concat(F.lit(cfg.slug_prefix + "-"), title), source).alias("slug"),
        F.concat(F.lit(cfg.title_prefix), title).alias("title_de"),
        F.concat(F.lit(cfg.title_prefix_zh), name).alias("title_zh"),
        fill(C.OFFICE_SUMMARY, office=F.lit(cfg.office_zh), topic_name=name, title=title).alias("summary_zh"),
        first_matching_line(content, C.FEE_PATTERNS).alias("fees_zh"),
        first_matching_line(content, C.DURATION_PATTERNS).alias("duration_zh"),
        F.array_join(contact if cfg.contact_lines is None else F.slice(contact, 1, cfg.contact_lines), "\n").alias("contact_info"),
        no_texts().alias("requirements_zh"),
        no_texts().alias("steps_zh"),
        F.lit(cfg.publisher).alias("publisher"),
        F.lit(cfg.source_name).alias("source_name"),
        F.lit(cfg.category).alias("category"),
        F.array(F.lit(cfg.office_zh), F.lit(cfg.default_title), F.lit(C.OFFICE_PERMIT_TAG), F.lit(cfg.city), topic).alias("tags"),
        source.alias("source_url"),
        F.lit(cfg.region_level).alias("region_level"),
        F.lit(cfg.city).alias("region_name"),
        F.lit(False).alias("translated"),
    )


def keyed_office_page(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Office guides of the second city, labelled by the key found in the address."""
    rows = _tokenised(pages, html).withColumn("_office", keyed_office(F.col(url)))
    h1 = F.nullif(trim_all(text_of(F.get(_texts(F.col("_tokens"), ["h1"]), F.lit(0)))), F.lit(""))
    values = {
        "key": F.col("_office.key"), "name": F.col("_office.title_zh"), "topic": F.col("_office.topic"),
        "title": F.coalesce(h1, F.col("_office.label")),
    }
    text = lambda field: fill(C.KEYED_OFFICE[field], **values)
    return rows.select(
        text("service_key").alias("service_key"),
        page_slug(text("slug_title"), F.col(url)).alias("slug"),
        *[text(f).alias(f) for f in ("title_de", "title_zh", "summary_zh", "publisher", "source_name", "region_level", "region_name")],
        values["topic"].alias("category"),
        F.array(*[fill(t, **values) for t in C.KEYED_OFFICE_TAGS]).alias("tags"),
        F.col(url).alias("source_url"),
        F.lit(False).alias("translated"),
    )


def news_page(pages: DataFrame, html: str = "html", static: bool = False) -> DataFrame:
    """Adds title, subtitle, date and paragraphs of a news page.

    The rendered variant reads the main (or article, or body) element, keeps paragraphs over
    50 characters without cookie or privacy wording; the static one keeps any over 30.
    """
    selectors = Selectors("main", "article", "body")
    rows = computed(_tokenised(pages, html, selectors), {"_root": selectors.first_root(F.col("_tokens"), F.col("_roots"), "main", "article", "body")})
    floor = 30 if static else 50

    def keep(t: Column) -> Column:
        good = t["tag"] == "p"
        return good if static else good & (F.col("_root").isNull() | under(t, F.col("_root")))

    texts = F.transform(F.filter("_tokens", keep), lambda t: trim_all(text_of(t)))

    def long_enough(x: Column) -> Column:
        good = F.length(x) > floor
        return good if static else good & ~x.contains("cookie") & ~x.contains("Datenschutz")

    head = lambda tag: F.coalesce(_trimmed_first(F.col("_tokens"), tag), F.lit(""))
    stamp = F.get(F.filter("_tokens", lambda t: t["tag"] == "time"), F.lit(0))
    meta = F.get(F.filter("_tokens", lambda t: (t["tag"] == "meta") & (t["href"] == "date")), F.lit(0))
    date = F.coalesce(F.nullif(stamp["href"], F.lit("")), trim_all(text_of(stamp)), trim_all(meta["title"]), F.lit(""))
    if static:
        date = F.regexp_extract(F.col(html), r"(\d{1,2}[./]\d{1,2}[./]\d{2,4})", 1)
    out = rows.withColumns({"news_title": head("h1"), "news_subtitle": head("h2"), "news_date": date,
                            "paragraphs": F.filter(texts, long_enough)})
    return out.drop("_tokens", "_texts", "_roots", "_root")


def _trimmed_first(tokens: Column, tag: str) -> Column:
    return trim_all(text_of(F.get(_texts(tokens, [tag]), F.lit(0))))


def page_links(pages: DataFrame, html: str = "html", url: str = "url", resolve: bool = True) -> DataFrame:
    """One row per link of a page: position, absolute url, text and title; anchors within the page skipped."""
    kept = [c for c in pages.columns if c != html]
    links = F.filter(
        "_tokens", lambda t: (t["tag"] == "a") & (F.coalesce(t["href"], F.lit("")) != "") & ~t["href"].startswith("#")
    )
    found = F.transform(links, lambda t: F.struct(t["href"].alias("href"), t["title"].alias("title"), trim_all(text_of(t)).alias("text")))
    rows = _tokenised(pages, html).select(*kept, F.posexplode(found).alias("pos", "link"))
    target = absolute_url(F.col("link.href"), F.col(url)) if resolve else F.col("link.href")
    rows = computed(rows, {"link_url": target})  # resolved once, however often it is filtered on
    return rows.select(
        *kept, "pos", "link_url", F.col("link.text").alias("link_text"), text_or(F.col("link.title"), F.col("link.text")).alias("link_title")
    )


def distinct_links(links: DataFrame, page_key: str) -> DataFrame:
    """First link to each address of a page, in page order."""
    found = links.where(F.coalesce(F.col("link_url"), F.lit("")) != "").select(page_key, "link_url", "pos", "link_text")
    return first_by(found, [page_key, "link_url"], [F.col("pos").asc()])


# --- templated and configured rows ----------------------------------------------------


def city_fee_guides(cities: DataFrame) -> DataFrame:
    """City fee rows ``(name, first, extra, url)`` to full policy rows from the guide templates."""
    columns = {"name": F.col("name"), "first": F.col("first"), "extra": F.col("extra"), "key": F.lower("name")}

    def text(field: str) -> Column:
        return fill(C.CITY_GUIDE[field], **columns)

    def texts(templates: list[str]) -> Column:
        return F.array(*[fill(t, **columns) for t in templates])

    same = ["title_de", "title_zh", "summary_zh", "fees_zh", "duration_zh", "publisher", "source_name", "category", "region_level"]
    return cities.select(
        text("service_key").alias("service_key"),
        page_slug(text("slug_title"), F.col("url")).alias("slug"),
        *[text(f).alias(f) for f in same],
        texts(C.CITY_GUIDE_REQUIREMENTS).alias("requirements_zh"),
        texts(C.CITY_GUIDE_STEPS).alias("steps_zh"),
        texts(C.CITY_GUIDE_TAGS).alias("tags"),
        F.col("url").alias("source_url"),
        F.col("name").alias("region_name"),
        F.lit(True).alias("translated"),
    )


ENTRY_DEFAULTS = ["source_name", "publisher", "region_level", "region_name", "category"]


def fill_defaults(entries: DataFrame, configs: DataFrame, key: str, as_of: str) -> DataFrame:
    """Fill missing entry fields from the source's configuration row (joined on ``key``).

    Only absent (null) fields are filled; an empty text counts as present.
    """
    renamed = configs.select(F.col(key), *[F.col(c).alias(f"d_{c}") for c in ENTRY_DEFAULTS])
    rows = entries.join(renamed, key, "left")
    updates = {}
    for name in ENTRY_DEFAULTS:
        own = F.col(name) if name in entries.columns else F.lit(None).cast("string")
        updates[name] = F.coalesce(own, F.col(f"d_{name}"))
    own_flag = F.col("translated") if "translated" in entries.columns else F.lit(None).cast("boolean")
    updates["translated"] = F.coalesce(own_flag, F.lit(False))
    own_time = F.col("last_fetched_at") if "last_fetched_at" in entries.columns else F.lit(None).cast("timestamp")
    updates["last_fetched_at"] = F.coalesce(own_time, F.lit(as_of).cast("timestamp"))
    own_url = F.col("source_url") if "source_url" in entries.columns else F.lit(None).cast("string")
    updates["source_url"] = F.coalesce(own_url, F.col("url")) if "url" in entries.columns else own_url
    return rows.withColumns(updates).drop(*[f"d_{c}" for c in ENTRY_DEFAULTS])
