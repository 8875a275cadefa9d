"""Faceted listings, search, sorting and paging.

Two listing generations exist with different semantics; they are separate functions.
Each takes a frame and returns a frame, so filters, column pruning and top-k stay
visible to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import within_days
from ..functions.taxonomy import normalize_policies, where_region
from ..functions.text import computed, escape_like, includes_text, normalize_text
from .visibility import visible


@dataclass(frozen=True)
class PolicyFilters:
    region_level: str | None = None
    region_name: str | None = None
    category: str | None = None
    target_group: str | None = None
    days: int = 0
    date_from: str | None = None
    date_to: str | None = None
    query: str | None = None
    status: str | None = None
    sort: str = "published_at"


@dataclass(frozen=True)
class PageFilters:
    category: str | None = None
    region_level: str | None = None
    region_name: str | None = None
    tags: list[str] = field(default_factory=list)
    query: str | None = None
    sort: str | None = None
    literal: bool = False


@dataclass(frozen=True)
class JobFilters:
    city: str | None = None
    state_code: str | None = None
    work_type: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    query: str | None = None
    literal: bool = False


def any_ilike(columns: list[str], term: str, literal: bool = False) -> Column:
    """Case-insensitive pattern search; wildcards in the term work unless ``literal``."""
    pattern = f"%{escape_like(term) if literal else term}%"
    cond = F.lit(False)
    for name in columns:
        cond = cond | F.col(name).ilike(pattern)
    return cond


def overlaps(column: str, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted]))


def where_text(df: DataFrame, columns: list[str], groups: str, query: str | None) -> DataFrame:
    """Normalised substring search over the given fields and the joined group list."""
    if not query:
        return df
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns] + [F.array_join(groups, " ")]
    rows = computed(df, {"_haystack": F.concat_ws(" ", *parts)})
    return rows.where(includes_text(normalize_text(F.col("_haystack")), query)).drop("_haystack")


SEARCH_FIELDS = ["title_zh", "title_de", "publisher", "region_name", "category", "summary_zh", "content_zh"]


def list_policies_v1(policies: DataFrame, filters: PolicyFilters, as_of: str, include_hidden: bool = False,
                     normalized: bool = False) -> DataFrame:
    """Matching rows of the first-generation list, display-normalised and unsorted.

    Filters on stored columns run before the normalisation and reach the scan; category,
    group, region and text filters see the inferred values.  Pass ``normalized=True`` for a
    table that already went through :func:`normalize_policies`: then every facet is pushed.
    """
    f = filters
    rows = visible(policies, "policy_v1", include_hidden)
    if f.status and f.status != "all":
        rows = rows.where(F.col("status") == f.status)
    if f.region_level:
        rows = rows.where(F.col("region_level") == f.region_level)
    if f.date_from:
        rows = rows.where(F.col("published_at") >= F.lit(f.date_from).cast("date"))
    if f.date_to:
        rows = rows.where(F.col("published_at") <= F.lit(f.date_to).cast("date"))
    if f.days > 0:
        rows = rows.where(within_days(F.col("published_at"), f.days, as_of))
    if not normalized:
        rows = normalize_policies(rows)
    if f.region_name:
        rows = where_region(rows, f.region_name)
    if f.category:
        rows = rows.where(F.col("category") == f.category)
    if f.target_group:
        rows = rows.where(F.array_contains("target_groups", f.target_group))
    return where_text(rows, SEARCH_FIELDS, "target_groups", f.query)


def policy_order(sort: str = "published_at") -> list[Column]:
    """Sort keys of the first-generation list; ties fall back to the date, then the id."""
    published = F.col("published_at").desc_nulls_last()
    first = {
        "effective_at": F.coalesce("effective_at", "published_at").desc_nulls_last(),
        "risk_level": F.when(F.col("risk_level") == "high", 3).when(F.col("risk_level") == "medium", 2)
        .otherwise(1).desc(),
        "view_count": F.coalesce(F.col("view_count"), F.lit(0)).desc(),
    }.get(sort)
    return ([first] if first is not None else []) + [published, F.col("id").asc()]


def sort_policies(df: DataFrame, sort: str = "published_at") -> DataFrame:
    return df.orderBy(*policy_order(sort))


def list_policies_v2(pages: DataFrame, filters: PageFilters, include_hidden: bool = False) -> DataFrame:
    """Matching rows of the second-generation list, unsorted: exact facets, tag overlap, pattern search."""
    f = filters
    rows = visible(pages, "policy", include_hidden)
    for name in ("category", "region_level", "region_name"):
        value = getattr(f, name)
        if value:
            rows = rows.where(F.col(name) == value)
    if f.tags:
        rows = rows.where(overlaps("tags", f.tags))
    if f.query:
        rows = rows.where(any_ilike(["title_zh", "title_de", "summary_zh"], f.query, f.literal))
    return rows


def page_order(sort: str | None = None) -> list[Column]:
    """View count on request, otherwise the fetch time, newest first; nulls lead a descending order."""
    name = "view_count" if sort == "view_count" else "last_fetched_at"
    return [F.col(name).desc_nulls_first(), F.col("id").asc()]


def list_jobs(jobs: DataFrame, filters: JobFilters) -> DataFrame:
    """Matching public jobs, unsorted."""
    f = filters
    rows = visible(jobs, "job")
    if f.city:
        rows = rows.where(F.col("city") == f.city)
    if f.state_code:
        rows = rows.where(F.col("state_code") == f.state_code)
    if f.work_type:
        rows = rows.where(overlaps("work_type", f.work_type))
    if f.tags:
        rows = rows.where(overlaps("tags", f.tags))
    if f.query:
        rows = rows.where(any_ilike(["title_zh", "title_de", "employer"], f.query, f.literal))
    return rows


def job_order() -> list[Column]:
    return [F.col("published_at").desc_nulls_first(), F.col("refnr").asc()]


def positive_or(value: int | None, default: int) -> int:
    return value if isinstance(value, int) and value > 0 else default


def paginate(df: DataFrame, order: list[Column], page: int | None = 1, size: int | None = 20) -> DataFrame:
    """One page of ``df`` in the given order (a distributed top-k, never a full sort)."""
    page, size = positive_or(page, 1), positive_or(size, 20)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_summary(df: DataFrame, page: int | None = 1, size: int | None = 20) -> DataFrame:
    """Total, page count and the from/to labels of a page; correct for pages out of range too."""
    page, size = positive_or(page, 1), positive_or(size, 20)
    total = F.col("total")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        F.ceil(total / size).cast("bigint").alias("total_pages"),
        F.when(total == 0, 0).otherwise((page - 1) * size + 1).cast("bigint").alias("from_row"),
        F.least(F.lit(page * size).cast("bigint"), total).alias("to_row"),
    )


def search_all(pages: DataFrame, jobs: DataFrame, query: str, n: int = 10, literal: bool = False) -> DataFrame:
    """Top ``n`` visible pages and top ``n`` visible jobs for a term, tagged by kind, ordered by key."""
    hits = list_policies_v2(pages, PageFilters(query=query, literal=literal)).orderBy("id").limit(n)
    jobs_hit = list_jobs(jobs, JobFilters(query=query, literal=literal)).orderBy("refnr").limit(n)
    as_row = lambda kind, key: [F.lit(kind).alias("kind"), F.col(key).alias("key"), "title_zh", "title_de"]
    return hits.select(*as_row("policy", "id")).unionByName(jobs_hit.select(*as_row("job", "refnr")))


def top_recent(df: DataFrame, n: int = 250) -> DataFrame:
    """Most recently updated rows for the admin list."""
    return df.orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").asc()).limit(n)


def _terms(policies: DataFrame) -> DataFrame:
    """Every term of every row with the row's place in list order."""
    words = F.filter(F.split(normalize_text(F.col("title_de")), " "), lambda w: F.length(w) > 4)
    terms = F.array_distinct(F.concat(F.array("category", "region_name"), F.col("target_groups"), words))
    rows = computed(policies.select("day", "id", "category", "region_name", "target_groups", "title_de"), {"terms": terms})
    return rows.select("day", "id", F.posexplode("terms").alias("pos", "term"))


def _first_terms(policies: DataFrame, n: int) -> DataFrame:
    first = _terms(policies).groupBy("term").agg(F.min(F.struct("day", "id", "pos")).alias("first_seen"))
    return first.orderBy("first_seen").limit(n).select("term", F.col("first_seen.id").alias("first_id"))


READ_AT_FIRST, READ_MOST = 8, 20_000  # rows for each wanted term, rows at most, before all rows are read


def suggestions(policies: DataFrame, n: int = 12, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First ``n`` distinct terms when rows are read in list order.

    Per row: category, region, groups, then the longer words of the German title.  Terms of the newest rows come first, so the
    newest rows that already have ``n`` distinct terms decide: a top-k by date and id picks them, eight times as many if
    they do not suffice.  Only these rows are handed to ``prepare`` (which may add or replace the columns that terms are
    made of).  Should even ``READ_MOST`` rows not have enough terms, all rows are aggregated.
    """
    # newest first: a descending date is an ascending negative day number; undated rows come last
    rows = policies.withColumn("day", F.coalesce(-F.unix_date("published_at"), F.lit(2**31 - 1)))
    prepare = prepare or (lambda df: df)
    take = READ_AT_FIRST * n
    while take <= READ_MOST:
        newest = prepare(rows.orderBy("day", "id").limit(take))
        if _terms(newest).select("term").distinct().limit(n).count() >= n:
            return _first_terms(newest, n)
        take *= 8
    return _first_terms(prepare(rows), n)


def facets(page: DataFrame, values: Column, order: list[str]) -> DataFrame:
    """Distinct values of one page of rows in first-seen order.

    ``values`` is an array column; ``order`` names the columns that order the page.
    """
    return (
        page.select(*order, F.posexplode(values).alias("pos", "value"))
        .groupBy("value")
        .agg(F.min(F.struct(*order, "pos")).alias("first_seen"))
        .orderBy("first_seen")
        .select("value")
    )

