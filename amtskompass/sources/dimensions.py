"""The fixed dimension tables as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as C


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """One of: categories, target_groups, job_tags, work_types, states, region_aliases, city_fees, guide_pages."""
    rows, schema = {
        "categories": ([(i, c) for i, c in enumerate(C.CATEGORIES)], "position int, category string"),
        "target_groups": ([(i, g) for i, g in enumerate(C.TARGET_GROUPS)], "position int, target_group string"),
        "job_tags": ([(i, t) for i, t in enumerate(C.JOB_TAGS)], "position int, tag string"),
        "work_types": (list(C.WORK_TYPES.items()), "code string, label string"),
        "states": (list(C.STATE_CODES.items()), "name string, code string"),
        "region_aliases": (C.REGION_ALIASES, "name string, state string, level string, pattern string"),
        "city_fees": (C.CITY_FEES, "name string, first string, extra string, url string"),
        "guide_pages": (C.GUIDE_PAGES, "name string, category string, tags array<string>, target_groups array<string>"),
    }[name]
    return spark.createDataFrame(rows, schema)
