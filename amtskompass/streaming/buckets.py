"""Tables in growing hash buckets: a bucket that has become too large is split when it is next written.

A bucket of level L holds the keys whose hash has a given remainder modulo ``buckets * 2**L``; its two children share its
remainder and differ in the next bit, so a split moves no key of any other bucket.  A manifest names for every bucket with
rows the version that wrote it and its number of rows: it is as long as the table has buckets, whatever they hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True, order=True)
class Bucket:
    level: int
    value: int

    @property
    def name(self) -> str:
        return f"b{self.level}_{self.value}"

    @classmethod
    def named(cls, name: str) -> Bucket:
        level, _, value = name[1:].partition("_")
        return cls(int(level), int(value))


@dataclass(frozen=True)
class Entry:
    version: int
    rows: int


def cell(buckets: int, level: int, key: str) -> Column:
    """Remainder of a key's hash at a level."""
    return F.pmod(F.xxhash64(key), F.lit(buckets << level))


def _ancestors(buckets: int, b: Bucket) -> list[Bucket]:
    return [Bucket(level, b.value % (buckets << level)) for level in range(b.level)]


def owner(buckets: int, leaves: set[Bucket], inner: set[Bucket], at: Bucket) -> Bucket:
    """The bucket that holds a cell: a known one, or the largest that overlaps no known one.  ``inner`` are the split ones."""
    way = [*_ancestors(buckets, at), at]
    known = next((b for b in way if b in leaves), None)
    return known or next((b for b in way if b not in inner), at)


def inner_of(buckets: int, leaves: Iterable[Bucket]) -> set[Bucket]:
    return {a for b in leaves for a in _ancestors(buckets, b)}


def children(buckets: int, b: Bucket, rows: int, most: int) -> list[Bucket]:
    """The bucket itself, or as many equal parts of it as its rows need."""
    down = max(0, math.ceil(math.log2(rows / most))) if rows > most else 0
    return [Bucket(b.level + down, b.value + i * (buckets << b.level)) for i in range(1 << down)]


def touched(rows: DataFrame, key: str, buckets: int, leaves: Iterable[Bucket]) -> set[Bucket]:
    """Buckets that the keys of ``rows`` fall into.  Collects one number for each cell, at most some for each bucket."""
    leaves = set(leaves)
    level = max((b.level for b in leaves), default=0)
    inner = inner_of(buckets, leaves)
    cells = rows.where(F.col(key).isNotNull()).select(cell(buckets, level, key).alias("c")).distinct().collect()
    return {owner(buckets, leaves, inner, Bucket(level, r["c"])) for r in cells}


def placed(rows: DataFrame, key: str, buckets: int, into: Iterable[Bucket]) -> DataFrame:
    """``rows`` with the name of their ``bucket``, one of ``into``."""
    into = sorted(into)
    level = max((b.level for b in into), default=0)
    cells = [
        (b.value + i * (buckets << b.level), b.name) for b in into for i in range(1 << (level - b.level))
    ]  # a few for each bucket, as the hash spreads rows evenly
    named = F.broadcast(rows.sparkSession.createDataFrame(cells, "_cell long, bucket string"))
    return rows.withColumn("_cell", cell(buckets, level, key)).join(named, "_cell").drop("_cell")


def write(rows: DataFrame, key: str, buckets: int, into: Iterable[Bucket], folder: str, schema: T.StructType, version: int) -> dict[Bucket, Entry]:
    """Write ``rows`` below ``folder`` by bucket and say what each bucket got.

    Rows are rebalanced by bucket: a large bucket is written by several tasks, small ones share a task, as the sizes
    measured in the shuffle tell.
    """
    into = list(into)
    if into:
        placed(rows, key, buckets, into).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    else:
        rows.limit(0).write.mode("overwrite").parquet(folder)
    there = rows.sparkSession.read.schema(T.StructType([*schema, T.StructField("bucket", T.StringType())])).parquet(folder)
    counts = there.groupBy("bucket").count().collect()  # from the files' footers; a row for each bucket
    return {Bucket.named(r["bucket"]): Entry(version, r["count"]) for r in counts if r["bucket"]}


def fresh(spark: SparkSession, rows: DataFrame, buckets: int, most: int) -> list[Bucket]:
    """Buckets for a whole table: as many levels at once as its rows need."""
    n = rows.count()
    return [c for v in range(buckets) for c in children(buckets, Bucket(0, v), -(-n // buckets), most)]
