"""Text blocks of enrichment batches, with the per-field length limits of the format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PROMPT_BLOCKS
from .text import fill


# Characters of a text that one prompt holds: format of the requests, never used for matching.
DESCRIPTION_CHARS, TAG_TITLE_CHARS, TAG_TEXT_CHARS, GUIDE_CHARS = 3000, 100, 2000, 4000


def description_block(cap: int = DESCRIPTION_CHARS) -> Column:
    """Job description (3000 characters in a batch, 1500 when retried alone)."""
    return fill(
        PROMPT_BLOCKS["description"], slot=F.col("slot"), refnr=F.col("refnr"), description=F.substring("description_de", 1, cap)
    )


def title_block() -> Column:
    return fill(PROMPT_BLOCKS["title"], slot=F.col("slot"), refnr=F.col("refnr"), title=F.col("title_de"))


def tag_block(title_cap: int = TAG_TITLE_CHARS, text_cap: int = TAG_TEXT_CHARS) -> Column:
    """Title and description for tagging; the translated description is preferred."""
    described = F.coalesce(F.nullif(F.col("description_zh"), F.lit("")), F.col("description_de"))
    return fill(
        PROMPT_BLOCKS["tags"], slot=F.col("slot"), refnr=F.col("refnr"), title=F.substring("title_de", 1, title_cap),
        description=F.substring(described, 1, text_cap),
    )


def guide_block(cap: int = GUIDE_CHARS) -> Column:
    """Guide page: keys, source, title and content (summary, else title)."""
    content = F.coalesce(F.nullif(F.col("summary_zh"), F.lit("")), F.col("title_de"))
    return fill(
        PROMPT_BLOCKS["guide"], slot=F.col("slot"), service_key=F.col("service_key"), source_name=F.col("source_name"),
        source_url=F.col("source_url"), title=F.col("title_de"), content=F.substring(content, 1, cap),
    )
