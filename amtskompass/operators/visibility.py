"""Who may see which rows, point lookups and public projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VISIBLE = {
    "policy": lambda: F.col("translated"),
    "job": lambda: F.col("translated") & F.col("is_active"),
    "policy_v1": lambda: F.col("status") == "published",
}


def visible(df: DataFrame, kind: str, include_hidden: bool = False) -> DataFrame:
    """Public rows of a table; administrators see everything."""
    return df if include_hidden else df.where(VISIBLE[kind]())


def get_by(df: DataFrame, key: str, value: str, kind: str | None = None) -> DataFrame:
    """Point lookup on a unique key, limited to the public rows of ``kind`` when given."""
    found = df if kind is None else visible(df, kind)
    return found.where(F.col(key) == value).limit(1)


def get_by_id_or_slug(df: DataFrame, value: str) -> DataFrame:
    """Id first, then slug; only published and expired rows are handed out.

    One pass: both keys are tested in the same scan and the better match is kept.
    """
    found = df.where((F.col("id") == value) | (F.col("slug") == value))
    best = found.orderBy((F.col("id") == value).desc(), "id").limit(1)
    return best.where(F.col("status").isin("published", "expired"))


def has_guide() -> Column:
    """Any structured guide field is filled."""
    return (
        (F.coalesce(F.size("requirements_zh"), F.lit(0)) > 0)
        | (F.coalesce(F.col("fees_zh"), F.lit("")) != "")
        | (F.coalesce(F.col("duration_zh"), F.lit("")) != "")
        | (F.coalesce(F.size("steps_zh"), F.lit(0)) > 0)
    )


# --- fixed values: null defaults of the public row types --------------------------
LIST_DEFAULTS = {
    "policy": ["requirements_zh", "steps_zh", "tags"],
    "job": ["work_type", "tags"],
    "policy_v1": ["target_groups", "key_changes"],
}
TEXT_DEFAULTS = {"policy": ["fees_zh", "duration_zh"], "job": [], "policy_v1": []}
COUNT_DEFAULTS = {"policy": ["view_count"], "job": [], "policy_v1": ["view_count"]}


def project_public(df: DataFrame, kind: str) -> DataFrame:
    """Null defaults for lists, texts and counters; jobs also get their display title."""
    updates: dict[str, Column] = {}
    for name in LIST_DEFAULTS[kind]:
        updates[name] = F.coalesce(F.col(name), F.array().cast("array<string>"))
    for name in TEXT_DEFAULTS[kind]:
        updates[name] = F.coalesce(F.col(name), F.lit(""))
    for name in COUNT_DEFAULTS[kind]:
        updates[name] = F.coalesce(F.col(name), F.lit(0))
    if kind == "job":
        updates["display_title"] = F.coalesce(F.col("title_zh"), F.col("title_de"))
    return df.withColumns(updates)


SEARCH_RESULT = [
    "id", "slug", "title_zh", "summary_zh", "region_name", "published_at", "category",
    "target_groups", "official_url", "risk_level",
]


def search_result(df: DataFrame, query: str | None) -> DataFrame:
    """Public search projection; no query gives no rows."""
    rows = df.select(*SEARCH_RESULT)
    return rows if query else rows.where(F.lit(False))
