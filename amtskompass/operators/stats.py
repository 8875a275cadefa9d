"""Counts and reports.  All are single-pass hash aggregations with partial results per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.labels import literal_map
from ..functions.taxonomy import with_regions
from .ranking import first_by


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def category_stats(df: DataFrame) -> DataFrame:
    return count_by(df, "category")


def region_stats(df: DataFrame) -> DataFrame:
    return count_by(df, "region_name")


def group_stats(df: DataFrame) -> DataFrame:
    """Rows per target group."""
    return count_by(df.select(F.explode("target_groups").alias("target_group")), "target_group")


def admin_stats(df: DataFrame) -> DataFrame:
    """Total, high risk, one count per status (zeros included) and the number of used statuses; one pass."""
    counts = {s: F.count_if(F.col("status") == s) for s in C.POLICY_STATUSES}
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"),
        *[n.alias(s) for s, n in counts.items()],
    ).withColumn("used_statuses", sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in counts), F.lit(0)))


def _has(column: str) -> Column:
    return F.col(column).isNotNull()


def job_status(jobs: DataFrame) -> DataFrame:
    """Progress of the job flow: the daily report's eight measures plus the stricter fetch backlog.

    ``waiting_for_fetch`` counts every inactive job; ``waiting_for_fetch_strict`` only those
    without a description.
    """
    active = F.col("is_active")
    described = _has("description_de") & (F.length("description_de") > 20)
    return jobs.agg(
        F.count_if(active).alias("active"),
        F.count_if(~active).alias("inactive"),
        F.count_if(active & ~_has("title_zh")).alias("active_missing_title_zh"),
        F.count_if(active & ~_has("description_de")).alias("active_missing_desc_de"),
        F.count_if(~active & described & _has("description_zh") & _has("title_zh")).alias("ready_to_activate"),
        F.count_if(~active).alias("waiting_for_fetch"),
        F.count_if(~active & ~_has("description_de")).alias("waiting_for_fetch_strict"),
        F.count_if(~active & described & ~_has("description_zh")).alias("waiting_for_translate"),
        F.count_if(~active & described & _has("description_zh") & ~_has("title_zh")).alias("waiting_for_title"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Processed, inserted, updated, skipped and failed pages of a run."""
    action = lambda name: F.count_if(F.col("action") == name)
    return diff.agg(
        F.count(F.lit(1)).alias("processed"),
        action("inserted").alias("inserted"),
        action("updated").alias("updated"),
        action("skipped").alias("skipped"),
        action("error").alias("errors"),
    )


def scrape_summary(gated: DataFrame, written: Column) -> DataFrame:
    """Fetched, changed, written and skipped pages of a conditional crawl."""
    changed = F.col("changed")
    return gated.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(changed & (F.coalesce(F.col("body"), F.lit("")) != "")).alias("changed"),
        F.count_if(changed & written).alias("written"),
        F.count_if(~changed).alias("skipped"),
    )


def collect_keywords(hits: DataFrame, key: str = "refnr") -> DataFrame:
    """Sorted set of the keywords that found a key.

    The pairs are made distinct first, so a key found a billion times still aggregates to its
    few keywords before anything is collected.
    """
    return (
        hits.select(key, "keyword").distinct().groupBy(key).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    )


def region_tree(policies: DataFrame) -> DataFrame:
    """States with their sorted cities: ``state, state_order, cities``.

    ``policies`` is display-normalised.  Federal rows are left out; a state without cities
    stays.  States follow the fixed order, unknown ones come last; names sort as in German.
    """
    local = policies.where(F.coalesce(F.col("region_level"), F.lit("")) != C.FEDERAL)
    names = local.select("region_name", "region_level").distinct()  # few pairs; classified after the aggregation
    pairs = with_regions(names).select(F.col("_state").alias("state"), F.col("region_name").alias("city")).distinct()
    city = F.when(F.col("city") != F.col("state"), F.col("city"))
    order = {name: str(i) for i, name in enumerate(C.STATE_CODES)}
    return (
        pairs.groupBy("state")
        # only alias regions differ from their state, so a set holds a handful of names
        .agg(F.collect_set(city).alias("found"))
        .select(
            "state",
            F.coalesce(F.try_element_at(literal_map(order), F.col("state")).cast("int"), F.lit(999)).alias("state_order"),
            F.transform(
                F.array_sort(F.transform("found", lambda c: F.struct(F.collate(c, "de").alias("key"), c.alias("city")))),
                lambda x: x["city"],
            ).alias("cities"),
        )
    )


def completeness(pages: DataFrame, by: list[str]) -> DataFrame:
    """Guides and complete guides (all four structured fields filled), with their share, per grouping."""
    whole = (
        (F.coalesce(F.size("requirements_zh"), F.lit(0)) > 0)
        & (F.coalesce(F.col("fees_zh"), F.lit("")) != "")
        & (F.coalesce(F.col("duration_zh"), F.lit("")) != "")
        & (F.coalesce(F.size("steps_zh"), F.lit(0)) > 0)
    )
    grouped = pages.groupBy(*by) if by else pages.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("guides"),
        F.count_if(whole).alias("complete"),
    ).withColumn("share", F.col("complete") / F.col("guides"))


def latest_review(reviews: DataFrame) -> DataFrame:
    """Newest review of every policy; ties fall to the smaller review id."""
    rows = reviews.where(F.coalesce(F.col("policy_id"), F.lit("")) != "")
    return first_by(rows, ["policy_id"], [F.col("reviewed_at").desc_nulls_last(), F.col("id").asc()])


def review_summary(reviews: DataFrame) -> DataFrame:
    """Distribution of the latest review status."""
    return count_by(latest_review(reviews), "review_status")


def review_progress(outcomes: DataFrame) -> DataFrame:
    """Completed and failed reviews per batch, with the progress label."""
    done, failed = F.count_if("ok"), F.count_if(~F.col("ok"))
    return outcomes.groupBy("batch_id").agg(
        done.alias("completed"),
        failed.alias("failed"),
        F.concat((done + failed).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("progress"),
    )
