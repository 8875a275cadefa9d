"""Feed parsing, relevance, health, discovery and repair of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.dates import normalize_date, since
from ..functions.needles import has_bit, rule_bits
from ..functions.text import absolute_url, bound, computed, decode_entities, strip_cdata, strip_tags, trim_all, url_origin
from .merge import dedupe_first, exclude_existing
from .ranking import take_per_group


def read_tag(block: Column, tag: str) -> Column:
    """Trimmed content of the first such element, CDATA wrapper removed; empty when absent."""
    return trim_all(strip_cdata(F.regexp_extract(block, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)))


def _first_of(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _blocks(body: Column, tag: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}\b.*?</{tag}>"), F.lit(0))


def parse_feed(fetches: DataFrame, body: str = "body") -> DataFrame:
    """One row per feed item with its position, title, link, description and date text.

    Entry blocks are read only when a feed has no item blocks.
    """
    kept = [c for c in fetches.columns if c != body]
    rows = computed(fetches, {"_body": F.col(body)})
    rows = computed(rows, {"_items": _blocks(F.col("_body"), "item")})
    blocks = F.when(F.size("_items") > 0, F.col("_items")).otherwise(_blocks(F.col("_body"), "entry"))
    rows = rows.select(*kept, F.posexplode(blocks).alias("pos", "block"))
    block = F.col("block")
    href = F.regexp_extract(block, r"""(?i)<link[^>]*href=["']([^"']+)["'][^>]*>""", 1)
    described = _first_of(read_tag(block, "description"), read_tag(block, "summary"), read_tag(block, "content"))
    dated = _first_of(read_tag(block, "pubDate"), read_tag(block, "published"), read_tag(block, "updated"))
    rows = computed(rows, {"_dated": dated})
    return rows.select(
        *kept,
        "pos",
        decode_entities(read_tag(block, "title")).alias("title"),
        trim_all(decode_entities(_first_of(read_tag(block, "link"), href))).alias("link"),
        decode_entities(strip_tags(described)).alias("description"),
        normalize_date(F.col("_dated")).alias("published_at"),
    )


def policy_relevant(title: Column, description: Column) -> Column:
    """No exclusion word and at least one inclusion word in the lower-cased title and description."""
    text = F.lower(F.concat_ws(" ", title, description))
    found = rule_bits(text, [("excluded", C.FEED_EXCLUDED), ("wanted", C.FEED_KEYWORDS)])
    return bound(found, lambda bits: ~has_bit(bits, 0) & has_bit(bits, 1))


def take_per_source(items: DataFrame, n: int, source: str = "source_id") -> DataFrame:
    """First ``n`` items per source in feed order."""
    return take_per_group(items, [source], [F.col("pos").asc(), F.col("link").asc()], n)


def select_feed_items(
    items: DataFrame, existing: DataFrame, since_date: str | None, per_source: int, all_items: bool = False
) -> DataFrame:
    """New, recent, relevant items, the first ``per_source`` of each source."""
    rows = items.where(F.col("link") != "").where(since(F.col("published_at"), since_date))
    if not all_items:
        rows = rows.where(policy_relevant(F.col("title"), F.col("description")))
    return take_per_source(exclude_existing(rows, existing, "link", "official_url"), per_source)


# --- health and repair ------------------------------------------------------------------

NO_URL = "Missing feedUrl."
NO_FEED = "URL did not return RSS/Atom content."
NO_ITEMS = "Feed had no items."


def _http_ok() -> Column:
    return F.col("status").between(200, 299) & F.col("error").isNull()


def feed_health(fetches: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``item_count, ok, probe_error`` and the looser ``reachable`` of the scheduled check."""
    text = F.coalesce(F.col(body), F.lit(""))
    count = F.regexp_count(text, F.lit(r"(?i)<(item|entry)\b"))
    is_feed = text.rlike(r"(?i)<(rss|feed)\b")
    failed = F.coalesce(F.col("error"), F.concat(F.lit("Fetch failed "), F.col("status").cast("string"), F.lit(" for "), F.col("url")))
    rows = fetches.withColumn("item_count", F.when(_http_ok(), count).otherwise(0))
    return rows.withColumns(
        {
            "ok": _http_ok() & (F.col("item_count") > 0),
            "probe_error": F.when(~_http_ok(), failed)
            .when(~is_feed & (F.col("item_count") == 0), NO_FEED)
            .when(F.col("item_count") == 0, NO_ITEMS)
            .otherwise(""),
            "reachable": _http_ok() & text.rlike(r"(?i)<(rss|feed|item|entry)\b"),
        }
    )


def discover_feeds(pages: DataFrame, html: str = "body", base: str = "url") -> DataFrame:
    """Feed addresses in a homepage: typed links first, then hrefs that look like feeds; made absolute."""
    kept = [c for c in pages.columns if c != html]
    source = F.col(html)
    quoted = """["']([^"']+)["']"""
    kind = """type=["']application/(?:rss|atom)\\+xml["']"""
    tags = F.regexp_extract_all(
        source, F.lit(f"""(?i)<link[^>]+(?:{kind}[^>]*href={quoted}|href={quoted}[^>]*{kind})[^>]*>"""), F.lit(0)
    )
    typed = F.transform(tags, lambda t: F.regexp_extract(t, f"(?i)href={quoted}", 1))
    anchors = F.regexp_extract_all(source, F.lit("""(?i)href=["']([^"']*(?:rss|feed|atom)[^"']*)["']"""), F.lit(1))
    rows = pages.select(*kept, F.posexplode(F.concat(typed, anchors)).alias("pos", "href"))
    found = rows.withColumn("candidate", absolute_url(F.col("href"), F.col(base)))
    return found.where(F.col("candidate") != "").drop("href")


def fallback_candidates(sources: DataFrame, homepage: str = "homepageUrl") -> DataFrame:
    """Well-known feed paths on the homepage's host, in probing order."""
    origin = url_origin(F.col(homepage))
    suffixes = F.array(*[F.lit(s) for s in C.FEED_PATH_SUFFIXES])
    return (
        sources.withColumn("_origin", origin)
        .where(F.col("_origin").isNotNull())
        .select("id", "_origin", F.posexplode(suffixes).alias("pos", "suffix"))
        .select("id", "pos", F.concat("_origin", "suffix").alias("candidate"))
    )


def unique_by_url(candidates: DataFrame, keys: list[str], url: str = "candidate") -> DataFrame:
    """First candidate per source and address, empty addresses dropped."""
    rows = candidates.where(F.coalesce(F.col(url), F.lit("")) != "")
    return rows.groupBy(*keys, url).agg(F.min("ord").alias("ord"))


def pick_repair(candidates: DataFrame) -> DataFrame:
    """First healthy candidate per source (``id, candidate, ord, ok, item_count``)."""
    return (
        candidates.where("ok")
        .groupBy("id")
        .agg(F.min_by(F.struct("candidate", "item_count"), "ord").alias("best"))
        .select("id", F.col("best.candidate").alias("suggested_feed_url"), F.col("best.item_count").alias("item_count"))
    )


def repair_candidates(sources: DataFrame, homepages: DataFrame) -> DataFrame:
    """Ordered distinct candidates of every source: homepage discoveries, then well-known paths."""
    pages = sources.select("id", F.col("homepageUrl").alias("url")).join(
        homepages.where(_http_ok()).select("url", "body"), "url"
    )
    found = discover_feeds(pages).select("id", F.struct(F.lit(0).alias("kind"), "pos").alias("ord"), "candidate")
    probes = fallback_candidates(sources).select("id", F.struct(F.lit(1).alias("kind"), "pos").alias("ord"), "candidate")
    return unique_by_url(found.unionByName(probes), ["id"])


def repair_report(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """Health verdict per source: ok, repair_found with the first healthy candidate, or needs_manual_check.

    ``checked`` counts the candidates probed: up to and including the first healthy one.
    """
    health = feed_health(fetches).select("url", "ok", "item_count", "probe_error")
    current = health.select(
        F.col("url").alias("feedUrl"), F.col("ok").alias("cur_ok"), F.col("item_count").alias("cur_items"),
        F.col("probe_error").alias("cur_error"),
    )
    known = sources.join(current, "feedUrl", "left").withColumn(
        "cur_ok", F.coalesce(F.col("cur_ok"), F.lit(False))
    )
    broken = known.where(~F.col("cur_ok"))
    probed = (
        repair_candidates(broken, fetches)
        .join(health.withColumnRenamed("url", "candidate"), "candidate", "left")
        .withColumn("ok", F.coalesce("ok", F.lit(False)))
    )
    first_ok = F.min(F.when(F.col("ok"), F.col("ord")))
    verdict = probed.groupBy("id").agg(
        F.min_by(F.when(F.col("ok"), F.col("candidate")), F.when(F.col("ok"), F.col("ord"))).alias("suggestion"),
        F.min_by(F.when(F.col("ok"), F.col("item_count")), F.when(F.col("ok"), F.col("ord"))).alias("items"),
        F.count(F.lit(1)).alias("candidates"),
        first_ok.alias("first_ok"),
    )
    before = (
        probed.select("id", "ord").join(verdict.select("id", "first_ok"), "id")
        .where(F.col("first_ok").isNull() | (F.col("ord") <= F.col("first_ok")))
        .groupBy("id").agg(F.count(F.lit(1)).alias("checked"))
    )
    rows = known.join(verdict, "id", "left").join(before, "id", "left")
    found = F.col("suggestion").isNotNull()
    missing = F.coalesce(F.col("feedUrl"), F.lit("")) == ""
    return rows.select(
        F.col("id").alias("source_id"),
        F.when(F.col("cur_ok"), "ok").when(found, "repair_found").otherwise("needs_manual_check").alias("status"),
        F.coalesce("feedUrl", F.lit("")).alias("current_feed_url"),
        F.coalesce("suggestion", F.lit("")).alias("suggested_feed_url"),
        F.when(F.col("cur_ok"), F.col("cur_items")).when(found, F.col("items")).otherwise(0).alias("item_count"),
        F.when(F.col("cur_ok") | found, "")
        .otherwise(F.coalesce(F.when(missing, F.lit(NO_URL)), "cur_error", F.lit("No valid feed candidate found.")))
        .alias("error"),
        F.when(F.col("cur_ok"), 0).otherwise(F.coalesce("checked", F.lit(0))).alias("checked"),
    )


def apply_repairs(sources: DataFrame, reports: DataFrame, as_of: str) -> DataFrame:
    """Registry with the found repairs applied: feed address, enabled flag, repair time."""
    fixes = reports.where((F.col("status") == "repair_found") & (F.col("suggested_feed_url") != "")).select(
        F.col("source_id").alias("_id"), F.col("suggested_feed_url").alias("_url")
    )
    fixed = F.col("_url").isNotNull()
    stamp = F.col("lastRepairedAt") if "lastRepairedAt" in sources.columns else F.lit(None).cast("string")
    return sources.join(fixes, F.col("id") == F.col("_id"), "left").withColumns(
        {
            "feedUrl": F.coalesce("_url", "feedUrl"),
            "enabled": F.when(fixed, F.lit(True)).otherwise(F.col("enabled")),
            "lastRepairedAt": F.when(fixed, F.lit(as_of)).otherwise(stamp),
        }
    ).drop("_id", "_url")


__all__ = [
    "apply_repairs", "dedupe_first", "discover_feeds", "fallback_candidates", "feed_health", "parse_feed", "pick_repair",
    "policy_relevant", "repair_candidates", "repair_report", "select_feed_items", "take_per_source", "unique_by_url",
]
