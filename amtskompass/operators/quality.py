"""Payload validation and constraint audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

# --- fixed values: minimum text lengths of a policy payload ---------------------------
MIN_LENGTHS = {
    "title_zh": 2, "title_de": 2, "publisher": 2, "published_at": 8, "region_name": 1, "category": 1,
    "summary_zh": 5, "user_notes": 5, "impact_zh": 5, "content_zh": 10,
}
ENUMS = {"region_level": C.REGION_LEVELS, "risk_level": C.RISK_LEVELS, "status": C.POLICY_STATUSES}
URL_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^\s/?#]+\S*|[^\s/]\S*)$"


def validation_issues() -> Column:
    """Names of the payload fields that break a rule, in a fixed order."""
    rules: dict[str, Column] = {n: F.length(F.col(n).cast("string")) >= k for n, k in MIN_LENGTHS.items()}
    rules["official_url"] = F.col("official_url").rlike(URL_PATTERN)
    rules.update({n: F.col(n).isin(values) for n, values in ENUMS.items()})
    rules["target_groups"] = F.size("target_groups") > 0
    rules["key_changes"] = (F.size("key_changes") > 0) & ~F.exists("key_changes", lambda x: F.length(x) < 1)
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


def validate_policies(df: DataFrame) -> DataFrame:
    """Adds ``issues`` and ``valid``; optional fields (effective date, German summary) are not checked."""
    return df.withColumn("issues", validation_issues()).withColumn("valid", F.size("issues") == 0)


def _checks(kind: str) -> tuple[dict[str, Column], list[str]]:
    """Row-level violation conditions and unique keys of a table."""
    null = lambda name: F.col(name).isNull()
    bad = lambda name, values: F.col(name).isNotNull() & ~F.col(name).isin(values)
    outside = (F.col("confidence") < 0) | (F.col("confidence") > 1)
    tables = {
        "policy_v1": (
            {
                "slug_null": null("slug"), "status_enum": bad("status", C.POLICY_STATUSES),
                "risk_enum": bad("risk_level", C.RISK_LEVELS), "level_enum": bad("region_level", C.REGION_LEVELS),
            },
            ["slug"],
        ),
        "policy": (
            {
                "title_null": null("title_de"), "summary_null": null("summary_zh"),
                "level_enum": bad("region_level", C.REGION_LEVELS),
            },
            ["service_key", "slug"],
        ),
        "job": ({"refnr_null": null("refnr"), "title_null": null("title_de")}, ["refnr"]),
        "queue": (
            {
                "type_enum": bad("source_type", C.QUEUE_SOURCE_TYPES), "status_enum": bad("status", C.QUEUE_STATUSES),
                "source_null": null("source_id"),
            },
            ["id"],
        ),
        "review": (
            {
                "status_enum": bad("review_status", C.REVIEW_STATUSES),
                "action_enum": bad("suggested_action", C.REVIEW_ACTIONS), "confidence_range": outside,
            },
            ["id"],
        ),
        "run": ({"mode_enum": bad("mode", C.RUN_MODES), "status_enum": bad("status", C.RUN_STATUSES)}, ["run_id"]),
    }
    return tables[kind]


def audit(df: DataFrame, kind: str) -> DataFrame:
    """Violations per constraint: ``rule, violations`` (zeros included).

    Row rules are one aggregation; each unique key is a count per key, aggregated before the
    shuffle, so a key that occurs a million times costs one row per task.
    """
    rules, keys = _checks(kind)
    counts = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    result = counts.select(F.inline(pairs))
    for key in keys:
        doubled = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        result = result.unionByName(
            doubled.agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(f"{key}_unique").alias("rule"), "violations")
        )
    return result


# table, column -> table, column it refers to
REFERENCES = {"review": ("policy_id", "policy", "id")}


def dangling(df: DataFrame, targets: DataFrame, kind: str = "review") -> DataFrame:
    """Rows whose reference is set but points to no row.  One anti-join; null refers to nothing and is allowed."""
    column, _, key = REFERENCES[kind]
    known = targets.select(F.col(key).cast("string").alias("_target"))
    return df.where(F.col(column).isNotNull()).join(known, F.col(column).cast("string") == F.col("_target"), "left_anti")


def audit_references(df: DataFrame, targets: DataFrame, kind: str = "review", key: str = "id", samples: int = 5) -> DataFrame:
    """``rule, violations, samples``: dangling references of a table, with the smallest keys of such rows."""
    column, other, _ = REFERENCES[kind]
    bad = dangling(df, targets, kind)
    first = bad.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(samples).agg(F.array_sort(F.collect_list("k")).alias("samples"))
    count = bad.agg(F.count(F.lit(1)).alias("violations"), F.lit(f"{column}_in_{other}").alias("rule"))
    return count.select("rule", "violations", first.select("samples").scalar().alias("samples"))


def reference_summary(df: DataFrame, targets: DataFrame, kind: str = "review") -> DataFrame:
    """``target, violations``: dangling references for each missing row they name."""
    column = REFERENCES[kind][0]
    return dangling(df, targets, kind).groupBy(F.col(column).alias("target")).agg(F.count(F.lit(1)).alias("violations"))
