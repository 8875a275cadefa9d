"""Scraper output and page archives to policy rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.keys import page_slug, scrape_slug, service_key


# Limits of the stored fields: format of the tables; keys and exclusions read whole texts.
DRAFT_SUMMARY_CHARS, DRAFT_PARAGRAPHS, ARCHIVE_TITLE_CHARS, ARCHIVE_SUMMARY_CHARS = 500, 3, 100, 5000


@dataclass(frozen=True)
class RegionConfig:
    region_name: str
    region_level: str
    publisher: str
    category: str
    origin: str


def drafts_from_scrape(items: DataFrame, config: RegionConfig, as_of: str) -> DataFrame:
    """Scraped news ``(title, url, date, paragraphs)`` to draft rows with default labels."""
    empty = F.array().cast("array<string>")
    paragraphs = F.coalesce(F.col("paragraphs"), empty)
    title, url = F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    whole = F.array_join(paragraphs, "\n\n")
    date = F.nullif(F.col("date"), F.lit(""))
    return items.select(
        scrape_slug(F.col("title"), F.col("url")).alias("slug"),
        title.alias("title_de"),
        title.alias("title_zh"),
        F.substring(whole, 1, DRAFT_SUMMARY_CHARS).alias("summary_zh"),
        F.array_join(F.slice(paragraphs, 1, DRAFT_PARAGRAPHS), "\n\n").alias("content_de_summary"),
        url.alias("official_url"),
        F.coalesce(date, F.lit(as_of[:10])).alias("published_at"),
        date.alias("effective_at"),
        F.lit(config.region_level).alias("region_level"),
        F.lit(config.region_name).alias("region_name"),
        F.lit(config.category).alias("category"),
        F.lit(config.publisher).alias("publisher"),
        F.lit("draft").alias("status"),
        F.lit("medium").alias("risk_level"),
        F.array(*[F.lit(g) for g in C.SCRAPE_TARGET_GROUPS]).alias("target_groups"),
        F.array(*[F.lit(k) for k in C.SCRAPE_KEY_CHANGES]).alias("key_changes"),
        F.lit(C.SCRAPE_USER_NOTES.format(origin=config.origin)).alias("user_notes"),
        whole.alias("content_zh"),
    )


@dataclass(frozen=True)
class ArchiveConfig:
    site: str
    prefix: str
    source_name: str
    publisher: str
    category: str
    region_level: str = "联邦"
    region_name: str = "Deutschland"


def load_archive_pages(pages: DataFrame, existing: DataFrame, config: ArchiveConfig, as_of: str) -> DataFrame:
    """Archived pages ``(path, title, content)`` to policy rows; already stored keys are skipped.

    The first content line becomes the German title when it is long enough and is not a
    navigation trail.  The stored summary holds at most 5000 characters by definition.
    """
    url = F.concat(F.lit(config.site.rstrip("/") + "/"), F.regexp_replace("path", "^en/", ""))
    first_line = F.substring_index("content", "\n", 1)
    usable = (F.length(first_line) > 30) & ~F.lower(first_line).contains("breadcrumb")
    rows = (
        pages.withColumn("source_url", url)
        .withColumn("service_key", service_key(F.col("source_url"), config.prefix))
        .withColumn("title_de", F.when(usable, F.substring(first_line, 1, ARCHIVE_TITLE_CHARS)).otherwise(F.col("title")))
    )
    stored = existing.select("service_key").distinct()
    return rows.join(stored, "service_key", "left_anti").select(
        "service_key",
        page_slug(F.col("title_de"), F.col("source_url")).alias("slug"),
        "title_de",
        F.col("title").alias("title_zh"),
        F.substring("content", 1, ARCHIVE_SUMMARY_CHARS).alias("summary_zh"),
        "source_url",
        F.lit(config.source_name).alias("source_name"),
        F.lit(config.publisher).alias("publisher"),
        F.lit(config.region_level).alias("region_level"),
        F.lit(config.region_name).alias("region_name"),
        F.lit(config.category).alias("category"),
        F.lit(False).alias("translated"),
        F.lit(as_of).cast("timestamp").alias("last_fetched_at"),
    )
