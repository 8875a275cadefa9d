"""Source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SOURCE


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry files: JSON arrays of sources."""
    return spark.read.schema(SOURCE).json(path, multiLine=True)


def active_sources(registry: DataFrame, needle: str | None = None) -> DataFrame:
    """Enabled sources with a feed; optionally those whose id, name, region or publisher contains a term."""
    live = registry.where(F.coalesce(F.col("enabled"), F.lit(True)) & (F.coalesce(F.col("feedUrl"), F.lit("")) != ""))
    if not needle:
        return live
    hit = F.lit(False)
    for name in ("id", "name", "regionName", "publisher"):
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle.lower()), F.lit(False))
    return live.where(hit)
