"""Seek paging: any page of a long list from the one or two partitions that hold it.

``paginate`` finds a page by a distributed top-k, whose last task receives as many rows as stand before the page's end.  An
index orders the rows once: they are range-partitioned by the order, written by partition, and the partitions are counted.
Page p then follows from the counts, and only the files of its partitions are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from .catalog import positive_or


@dataclass(frozen=True)
class PageIndex:
    """Ordered rows below ``path`` and the rows of each of their partitions (as many numbers as partitions)."""

    spark: SparkSession
    path: str
    schema: T.StructType
    order: tuple[Column, ...]
    counts: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def span(self, first: int, size: int) -> tuple[list[int], int]:
        """Partitions that hold the rows ``first`` to ``first + size - 1``, and the rows of the first one before them."""
        before, parts, skip = 0, [], 0
        for part, n in enumerate(self.counts):
            if before < first + size and before + n > first:
                skip = skip if parts else first - before
                parts.append(part)
            before += n
        return parts, skip

    def page(self, page: int | None = 1, size: int | None = 20) -> DataFrame:
        """The same rows as ``paginate``; partitions before the page are not read."""
        page, size = positive_or(page, 1), positive_or(size, 20)
        parts, skip = self.span((page - 1) * size, size)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema, T.StructField("_part", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/_part={p}" for p in parts])
        return rows.orderBy("_part", *self.order).offset(skip).limit(size).drop("_part")


def page_index(rows: DataFrame, order: Sequence[Column], partitions: int | None = None, path: str | None = None) -> PageIndex:
    """Write the index of ``rows`` (give it the columns that a page shows).  ``order`` must be unique."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    placed.write.partitionBy("_part").parquet(path)
    stored = spark.read.schema(T.StructType([*rows.schema, T.StructField("_part", T.IntegerType())])).parquet(path)
    counted = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}
    return PageIndex(spark, path, rows.schema, tuple(order), tuple(counted.get(i, 0) for i in range(max(counted, default=-1) + 1)))
