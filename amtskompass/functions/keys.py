"""Slugs, service keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text, strip_marks


def _dashed(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def feed_slug(value: Column) -> Column:
    """Readable part (at most 72) plus the first 8 digits of sha1 of the value."""
    readable = _dashed(F.replace(strip_marks(F.lower(value)), F.lit("ß"), F.lit("ss")))
    head = F.coalesce(F.nullif(F.substring(readable, 1, 72), F.lit("")), F.lit("policy"))
    return F.concat(head, F.lit("-"), F.substring(F.sha1(value), 1, 8))


def page_slug(title: Column, url: Column) -> Column:
    """Title part (at most 60) plus the first 6 digits of md5 of the url."""
    return F.concat(
        F.substring(_dashed(F.lower(F.trim(title))), 1, 60), F.lit("-"), F.substring(F.md5(url), 1, 6)
    )


def scrape_slug(title: Column, url: Column) -> Column:
    """Slug that keeps CJK letters: title, shortened url and md5 joined by three dashes."""
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled"))
    base = F.regexp_replace(F.lower(title), r"[^a-z0-9\u4e00-\u9fff\s-]", "")
    base = F.substring(F.regexp_replace(base, r"\s+", "-"), 1, 50)
    link = F.coalesce(url, F.lit(""))
    tail = F.substring(F.replace(F.regexp_replace(link, "https?://", ""), F.lit("/"), F.lit("-")), 1, 30)
    digest = F.substring(F.md5(F.coalesce(F.nullif(link, F.lit("")), title)), 1, 8)
    return F.concat_ws("---", base, tail, digest)


def timed_slug(value: Column, created_at: Column) -> Column:
    """Umlauts spelled out, plus the creation time in base 36."""
    text = normalize_text(value)
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(umlaut), F.lit(plain))
    head = F.coalesce(F.nullif(_dashed(text), F.lit("")), F.lit("policy"))
    millis = F.unix_millis(created_at.cast("timestamp")).cast("string")
    return F.concat(head, F.lit("-"), F.lower(F.conv(millis, 10, 36)))


def service_key(url: Column, prefix: str = "") -> Column:
    """Stable page key; very long ones are cut to 80 characters plus a url digest."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    key = F.regexp_replace(F.concat(F.lit(prefix + "_"), bare), "[^a-zA-Z0-9_]", "_")
    key = F.lower(F.regexp_replace(F.regexp_replace(key, "_+", "_"), "^_+|_+$", ""))
    short = F.concat(F.substring(key, 1, 80), F.lit("_"), F.substring(F.md5(url), 1, 8))
    return F.when(F.length(key) > 100, short).otherwise(key)


def content_hash(col: Column, algorithm: str = "md5") -> Column:
    """Change-detection hash of whichever text the caller chose; missing text hashes as empty."""
    text = F.coalesce(col, F.lit(""))
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def visible_text_hash(html: Column) -> Column:
    """md5 of the page text without script, style, noscript, comments, tags and blank runs."""
    bare = html
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, f"(?is)<{tag}\\b.*?</{tag}>", "")
    bare = F.regexp_replace(bare, "(?s)<!--.*?-->", "")
    pieces = F.transform(F.split(bare, "<[^>]*>"), lambda p: F.regexp_replace(p, r"^\s+|\s+\z", ""))
    return F.md5(F.array_join(pieces, ""))
