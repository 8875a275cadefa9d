"""Job flow: merging keyword hits, selectors and the full synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import infer_work_type
from ..functions.text import computed
from ..sources.job_api import hit_refnr, normalize_jobs
from .merge import defer_activate, upsert
from .ranking import first_by

HIT_ORDER = ["kw_ord", "page", "pos"]


def first_hits(hits: DataFrame) -> DataFrame:
    """One row per reference number: the first hit in search order (a partial top-1 before the shuffle)."""
    keyed = computed(hits.select("item", *HIT_ORDER), {"refnr": hit_refnr(F.col("item"))}).where(F.col("refnr") != "")
    return first_by(keyed, ["refnr"], [F.col(c).asc() for c in HIT_ORDER]).select("refnr", "item")


def merge_job_hits(hits: DataFrame) -> DataFrame:
    """One row per reference number: the first hit in search order, with its set of keywords.

    ``hits`` have their payload (``item``), or are normalised already: then columns that nobody reads afterwards are neither
    sorted nor sent.  Each task keeps its first hit per reference number and keyword before anything is shuffled; the few
    that are left are aggregated, each column for itself.
    """
    keyed = hits if "refnr" in hits.columns else computed(hits, {"refnr": hit_refnr(F.col("item"))})
    order, key = [F.col(c).asc() for c in HIT_ORDER], ["refnr", "keyword"]
    firsts = first_by(keyed.where(F.col("refnr") != ""), key, order)
    carried = [c for c in firsts.columns if c not in (*key, *HIT_ORDER)]
    return firsts.groupBy("refnr").agg(
        *[F.min_by(c, F.struct(*HIT_ORDER)).alias(c) for c in carried],
        F.array_sort(F.collect_set("keyword")).alias("keywords"),
    )


def sync_jobs(
    jobs: DataFrame, hits: DataFrame, as_of: str, defer: bool = False, preserve: Sequence[str] = (), min_fetched: int = 0
) -> DataFrame:
    """Jobs after one synchronisation: merge hits, normalise, upsert, delist.

    By default a re-seen job loses its tags and its translated flag, as the payload carries
    both; name them in ``preserve`` to keep them.  With ``defer`` new jobs stay inactive.

    The join of the upsert also tells which stored jobs were not fetched, so delisting needs
    neither a second join nor a second parse.  ``min_fetched`` skips it for a too small fetch.
    """
    fetched = normalize_jobs(first_hits(hits), as_of)
    if defer:
        fetched = defer_activate(fetched, jobs)
    # keys are unique by construction of the merge
    merged = upsert(jobs, fetched, "refnr", as_of, preserve, unique=True, mark="_seen")
    gone = F.col("is_active") & ~F.col("_seen")
    if min_fetched > 0:
        gone = gone & fetched.agg(F.count(F.lit(1)) >= min_fetched).scalar()
    stamp = F.lit(as_of).cast("timestamp")
    return merged.withColumns(
        {
            "updated_at": F.when(gone, stamp).otherwise(F.col("updated_at")),
            "is_active": F.when(gone, F.lit(False)).otherwise(F.col("is_active")),
        }
    ).drop("_seen")


def sync_counts(jobs: DataFrame, hits: DataFrame) -> DataFrame:
    """Fetched, upserted and deactivated counts of a synchronisation."""
    keys = hits.select(hit_refnr(F.col("item")).alias("refnr")).where(F.col("refnr") != "").distinct()
    flags = jobs.select("refnr", "is_active").join(
        keys.withColumn("_seen", F.lit(True)), "refnr", "full_outer"
    )
    seen = F.col("_seen").isNotNull()
    return flags.agg(
        F.count_if(seen).alias("fetched"),
        F.count_if(seen).alias("upserted"),
        F.count_if(F.coalesce("is_active", F.lit(False)) & ~seen).alias("deactivated"),
    )


def apply_details(jobs: DataFrame, details: DataFrame, as_of: str) -> DataFrame:
    """Descriptions and work types from fetched job details; failed fetches leave the row alone."""
    d = details.where(F.coalesce("stellenangebotsBeschreibung", F.lit("")) != "").select(
        "refnr",
        F.col("stellenangebotsBeschreibung").alias("description_de"),
        infer_work_type(
            F.col("istGeringfuegigeBeschaeftigung"), F.col("arbeitszeitTeilzeitVormittag"),
            F.col("arbeitszeitTeilzeitNachmittag"), F.col("stellenangebotsTitel"), F.col("stellenangebotsBeschreibung"),
        ).alias("work_type"),
    )
    known = d.join(jobs.select("refnr"), "refnr", "left_semi")
    return upsert(jobs, known, "refnr", as_of)


def _limited(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """First ``limit`` rows in order; without a limit all rows, which then need no order."""
    return df.orderBy(*order).limit(limit) if limit > 0 else df


def jobs_missing_detail(jobs: DataFrame, limit: int = 0, strict: bool = False) -> DataFrame:
    """Jobs whose description is missing or too short, inactive ones first.

    ``strict`` is the variant that still counts exactly 20 characters as long enough.
    """
    short = F.length("description_de") < 20 if strict else F.length("description_de") <= 20
    rows = jobs.where(F.col("description_de").isNull() | short).select("refnr", "title_de", "is_active")
    return _limited(rows, limit, F.col("is_active").asc(), F.col("refnr").asc())


def pending_work(df: DataFrame, kind: str, limit: int = 0) -> DataFrame:
    """Rows waiting for enrichment.

    Kinds: ``description``, ``title``, ``active_title`` (active jobs only), ``title_null``
    (null titles only) and ``policy``.
    """
    order = [F.col("refnr").asc()]
    if kind == "description":
        ready = F.col("description_de").isNotNull() & (F.length("description_de") > 20)
        todo = F.coalesce("description_zh", F.lit("")) == ""
        rows = df.where(ready & todo).select("refnr", "title_de", "employer", "description_de")
    elif kind in ("title", "active_title", "title_null"):
        rows = df.where(F.col("is_active")) if kind == "active_title" else df
        todo = F.col("title_zh").isNull() if kind == "title_null" else F.coalesce("title_zh", F.lit("")) == ""
        rows = rows.where(todo).select("refnr", "title_de")
    elif kind == "policy":
        waiting = df.where(~F.col("translated"))
        if limit > 0:
            waiting = waiting.orderBy(F.col("last_fetched_at").desc_nulls_first(), F.col("service_key").asc()).limit(limit)
        return waiting.select("service_key", "title_de", "source_name", "source_url", F.coalesce("summary_zh", "title_de").alias("content"))
    else:
        raise ValueError(f"unknown kind of work: {kind}")
    return _limited(rows, limit, *order)


def jobs_missing_tags(jobs: DataFrame, limit: int = 0) -> DataFrame:
    """Active, described jobs without tags."""
    rows = jobs.where(
        F.col("is_active")
        & F.col("description_zh").isNotNull()
        & (F.length("description_zh") > 10)
        & (F.coalesce(F.size("tags"), F.lit(0)) <= 0)
    )
    return _limited(rows.select("refnr", "title_de", "description_zh", "description_de"), limit, F.col("refnr").asc())


def review_candidates(policies: DataFrame, limit: int = 20, id: str | None = None, slug: str | None = None,
                      region: str | None = None, category: str | None = None, status: str = "all") -> DataFrame:
    """Policies to review next: exact filters, literal case-insensitive region search, newest update first."""
    rows = policies
    for name, value in (("id", id), ("slug", slug), ("category", category)):
        if value:
            rows = rows.where(F.col(name) == value)
    if region:
        rows = rows.where(F.lower("region_name").contains(region.lower().replace(",", " ")))
    if status != "all":
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").asc()).limit(limit)


def with_state_code(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Two-letter code of the region name stored on a job (dimension join)."""
    return jobs.join(
        states.select(F.col("name").alias("_state"), "code"), F.col("state_code") == F.col("_state"), "left"
    ).drop("_state")
