"""Category, target-group and region rules over normalised text.

Two generations of rules exist on purpose: the display rules re-classify stored
rows, the ingest rules classify incoming drafts.  They are never merged.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C
from .needles import all_labels, first_label, has_bit, rule_bits
from .text import bound, collapse_spaces, computed, contains_any, distinct_in_order, nfkc, text_or, trim_all


def lookup_text(col: Column) -> Column:
    """Rule text: trimmed, lower, NFKC, disclaimer sentences blanked, single blanks."""
    text = nfkc(F.lower(trim_all(col)))
    for pattern in C.DISCLAIMER_PATTERNS:
        text = _without(text, pattern)
    return collapse_spaces(text)


def _without(text: Column, pattern: str) -> Column:
    """Text with a pattern blanked; the pattern only runs where its literal beginning occurs."""
    start = pattern.partition(".")[0]
    return bound(text, lambda t: F.when(t.contains(start), F.regexp_replace(t, pattern, " ")).otherwise(t))


def taxonomy_source(
    title_zh: Column, title_de: Column, summary: Column, changes: Column, summary_de: Column
) -> Column:
    """The non-empty classified fields joined by blanks."""
    parts = F.concat(
        F.array(title_zh, title_de, summary), F.coalesce(changes, F.array().cast("array<string>")), F.array(summary_de)
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


BLUE_CARD_RULE = [(C.BLUE_CARD_GROUP, C.BLUE_CARD_NEEDLES)]
DISPLAY_RULES = (C.DISPLAY_CATEGORY_RULES, C.GROUP_RULES, BLUE_CARD_RULE)
GROUPS_AT = len(C.DISPLAY_CATEGORY_RULES)
BLUE_CARD_AT = GROUPS_AT + len(C.GROUP_RULES)


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def display_bits(text: Column | str) -> Column:
    """What the display rules for categories and groups find in a lookup text, in one pass."""
    return rule_bits(_column(text), *DISPLAY_RULES)


def category_of(bits: Column) -> Column:
    return first_label(bits, C.DISPLAY_CATEGORY_RULES, F.lit(C.OTHER_CATEGORY))


def groups_of(bits: Column, category: Column) -> Column:
    work_group = F.when(has_bit(bits, BLUE_CARD_AT), C.BLUE_CARD_GROUP).otherwise(C.WORK_VISA_GROUP)
    implied = F.when(category == C.WORK_CATEGORY, work_group)
    for name, group in C.CATEGORY_GROUPS.items():
        implied = implied.when(category == name, F.lit(group))
    return distinct_in_order(all_labels(bits, C.GROUP_RULES, GROUPS_AT), F.array_compact(F.array(implied)))


def display_category(text: Column | str) -> Column:
    """Category of a lookup text; the first matching rule wins."""
    return bound(rule_bits(_column(text), C.DISPLAY_CATEGORY_RULES), category_of)


def matched_groups(text: Column | str, category: Column) -> Column:
    """Target groups found in a lookup text or implied by its display category, in rule order."""
    return bound(display_bits(text), lambda bits: groups_of(bits, category))


def alias_index(text: Column) -> Column:
    """Position of the first region alias found in a lookup text; null when there is none."""
    result = None
    for i, alias in enumerate(C.REGION_ALIASES):
        hit = text.rlike(alias[3])
        result = F.when(hit, F.lit(i)) if result is None else result.when(hit, F.lit(i))
    return result


def _alias_field(index: Column, field: int) -> Column:
    """Name (0), state (1) or level (2) of an alias position."""
    return F.get(F.array(*[F.lit(a[field]) for a in C.REGION_ALIASES]), index)


def with_regions(df: DataFrame, name: str = "region_name", level: str = "region_level") -> DataFrame:
    """Adds ``_level`` (valid, else alias, else state level), ``_region`` and ``_state``.

    The region names follow the level given in ``level`` as it is stored.
    """
    rows = computed(df, {"_rtext": lookup_text(F.col(name))})
    rows = computed(rows, {"_alias": alias_index(F.col("_rtext"))})
    alias, text = F.col("_alias"), F.col("_rtext")
    valid = F.when(F.col(level).isin(C.REGION_LEVELS), F.col(level))
    is_federal = F.coalesce(F.col(level) == C.FEDERAL, F.lit(False))
    federal = is_federal | contains_any(text, C.FEDERAL_NEEDLES)
    region = F.when(federal, C.FEDERAL).otherwise(F.coalesce(_alias_field(alias, 0), trim_all(F.col(name))))
    rows = computed(rows, {"_level": F.coalesce(valid, _alias_field(alias, 2), F.lit("州")), "_region": region})
    state = F.when(is_federal, C.FEDERAL).otherwise(F.coalesce(_alias_field(alias, 1), F.col("_region")))
    return computed(rows, {"_state": state}).drop("_rtext", "_alias")


def normalize_regions(df: DataFrame) -> DataFrame:
    """Display normalisation of region level and name, one pass; the name follows the normalised level."""
    rows = computed(df, {"_rtext": lookup_text(F.col("region_name"))})
    rows = computed(rows, {"_alias": alias_index(F.col("_rtext"))})
    valid = F.when(F.col("region_level").isin(C.REGION_LEVELS), F.col("region_level"))
    rows = rows.withColumn("region_level", F.coalesce(valid, _alias_field(F.col("_alias"), 2), F.lit("州")))
    federal = (F.col("region_level") == C.FEDERAL) | contains_any(F.col("_rtext"), C.FEDERAL_NEEDLES)
    name = F.when(federal, C.FEDERAL).otherwise(F.coalesce(_alias_field(F.col("_alias"), 0), trim_all(F.col("region_name"))))
    return rows.withColumn("region_name", name).drop("_rtext", "_alias")


def normalize_policies(df: DataFrame, regions: bool = True, groups: bool = True) -> DataFrame:
    """Display normalisation of stored policies: category, groups, region level and name.

    Every step is computed once per row; parts that a query does not read can be left out.
    Materialise the result to make every facet a pushable column.
    """
    source = taxonomy_source(
        F.col("title_zh"), F.col("title_de"), F.col("summary_zh"), F.col("key_changes"), F.col("content_de_summary")
    )
    rows = computed(df, {"_source": source})
    rows = computed(rows, {"_text": lookup_text(F.col("_source"))}).drop("_source")
    rows = computed(rows, {"_bits": display_bits("_text")}).drop("_text")
    rows = computed(rows, {"category": category_of(F.col("_bits"))})
    if groups:
        rows = computed(rows, {"target_groups": groups_of(F.col("_bits"), F.col("category"))})
        found = F.col("target_groups")
        rows = rows.withColumn("target_groups", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(C.DEFAULT_GROUP))))
    rows = rows.drop("_bits")
    return normalize_regions(rows) if regions else rows


def wanted_region(wanted: str) -> str:
    """Normalised form of a wanted region given by a user (driver side, one constant)."""
    text = " ".join(unicodedata.normalize("NFKC", wanted.strip().lower()).split())
    if any(n in text for n in C.FEDERAL_NEEDLES):
        return C.FEDERAL
    return next((a[0] for a in C.REGION_ALIASES if re.search(a[3], text)), wanted.strip())


def where_region(df: DataFrame, wanted: str, name: str = "region_name", level: str = "region_level") -> DataFrame:
    """Rows whose normalised region or state equals the normalised wanted region."""
    want = wanted_region(wanted)
    rows = with_regions(df, name, level)
    return rows.where((F.col("_region") == want) | (F.col("_state") == want)).drop("_level", "_region", "_state")


# --- ingest generation ------------------------------------------------------------


def ingest_text(*parts: Column) -> Column:
    """Joined non-empty texts (columns or arrays), lower case and NFKC, no disclaimer stripping."""
    joined = F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), " ")
    return nfkc(F.lower(joined))


def ingest_category(reply: Column, fallback: Column, text: Column) -> Column:
    """A canonical reply value is accepted; anything else is classified from the text."""
    raw = text_or(reply, fallback)
    found = rule_bits(F.when(F.coalesce(raw.isin(C.INGEST_CATEGORIES), F.lit(False)), F.lit(None)).otherwise(text), C.INGEST_CATEGORY_RULES)
    ruled = bound(found, lambda bits: first_label(bits, C.INGEST_CATEGORY_RULES, F.lit(C.OTHER_CATEGORY)))
    return F.when(raw.isin(C.INGEST_CATEGORIES), raw).otherwise(ruled)


def ingest_groups(reply_groups: Column, text: Column, fallback: Column) -> Column:
    """Canonical reply groups first, then the keyword rules."""
    known = F.filter(F.transform(reply_groups, trim_all), lambda g: g.isin(C.TARGET_GROUPS))
    groups = distinct_in_order(known, bound(rule_bits(text, C.GROUP_RULES), lambda bits: all_labels(bits, C.GROUP_RULES)))
    return F.when(F.size(groups) > 0, groups).otherwise(fallback)


def ingest_level(value: Column, fallback: Column) -> Column:
    """Region level from free text; note that a land needle also hits country names."""
    text = text_or(value, fallback)
    low = F.lower(text)
    return (
        F.when(text.contains("联邦") | low.contains("bund"), "联邦")
        .when(text.contains("Landkreis") | text.contains("县"), "Landkreis")
        .when(text.contains("市") | contains_any(low, ["stadt", "city"]), "市")
        .when(text.contains("州") | contains_any(low, ["land", "state"]), "州")
        .otherwise(F.when(fallback.isin(C.REGION_LEVELS), fallback).otherwise("州"))
    )
