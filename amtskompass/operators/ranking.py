"""Global order without a global window: ranks, running totals, budget admission, batches.

A window without a partition key would pull the whole table into one task.  Instead the
rows are range-partitioned by the order, frozen in the checkpoint folder (so partition
numbers are stable when an executor is lost), totalled per partition, and the few partition
totals are prefix-summed and added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in the lower 33 bits


def _ranged(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Range-partitioned, sorted and frozen rows with their partition and position."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = placed.withColumn("_mid", F.monotonically_increasing_id())
    return reliable_checkpoint(
        numbered.withColumns(
            {
                "_part": F.shiftright("_mid", ROW_BITS).cast("int"),
                "_pos": F.col("_mid").bitwiseAND((1 << ROW_BITS) - 1),
            }
        ).drop("_mid")
    )


def _offsets(totals: DataFrame, value: str) -> DataFrame:
    """Prefix sums over one row per partition (at most the number of range partitions)."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_before"))


def global_rank(
    df: DataFrame, order: Sequence[Column], out: str = "rank", partitions: int | None = None, key: Sequence[str] | None = None
) -> DataFrame:
    """1-based position of every row in a total order.  The order must be unique.

    With ``key``, unique columns that the order is made of, only these are sorted and frozen; the other columns are joined
    back when the result is read, so the job that runs at once never sees them.
    """
    if key is not None:
        ranks = global_rank(df.select(*key), order, out, partitions)
        return df.join(ranks, list(key))
    rows = _ranged(df, order, partitions)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = F.broadcast(_offsets(counts, "_n"))
    return rows.join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_pos") + 1).drop("_part", "_pos", "_before")


def running_total(
    df: DataFrame, order: Sequence[Column], value: str, out: str = "running", partitions: int | None = None, key: Sequence[str] | None = None
) -> DataFrame:
    """Sum of ``value`` over all rows up to and including each row of a unique total order.

    With ``key``, unique columns that the order is made of, only these and the value are sorted and frozen.
    """
    if key is not None:
        totals = running_total(df.select(*dict.fromkeys([*key, value])), order, value, out, partitions)
        return df.join(totals.drop(*{value} - set(key)), list(key))
    rows = _ranged(df, order, partitions)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_n"))
    offsets = F.broadcast(_offsets(sums, "_n"))
    within = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_own", F.sum(value).over(within))
        .join(offsets, "_part")
        .withColumn(out, F.col("_before") + F.col("_own"))
        .drop("_part", "_pos", "_before", "_own")
    )


def admit_by_budget(
    items: DataFrame, budget: int, order: Sequence[str] = ("source_idx", "pos"), cost: str = "cost"
) -> DataFrame:
    """Items in order, admitted while the cost used before them is below the budget.

    Adds ``used_before`` and ``admitted``; the first item that is not admitted is the resume point.
    """
    narrow = None if set(items.columns) <= {*order, cost} else list(order)  # other columns are joined back
    rows = running_total(items, [F.col(c).asc() for c in order], cost, "used_after", key=narrow)
    before = F.col("used_after") - F.col(cost)
    return rows.withColumn("used_before", before).withColumn("admitted", before < budget)


def budget_summary(admitted: DataFrame, source: str = "source_idx") -> DataFrame:
    """One row: admitted items, used requests, and the source to resume at (null when all fit)."""
    return admitted.agg(
        F.count_if("admitted").alias("admitted"),
        F.coalesce(F.sum(F.when(F.col("admitted"), F.col("cost"))), F.lit(0)).alias("request_used"),
        F.min(F.when(~F.col("admitted"), F.col(source))).alias("resume_source"),
    )


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.  Plans as a partial top-1 before the shuffle."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def take_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in the given order."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def make_batches(
    df: DataFrame, order: Sequence[Column], size: int, block: Column, partitions: int | None = None, key: Sequence[str] | None = None
) -> DataFrame:
    """Consecutive batches of ``size`` rows with their prompt text.

    ``block`` renders one row; it may use the columns of ``df`` and ``slot`` (1-based position
    in the batch).  A batch holds ``size`` rows at most, so its text is bounded by the caps in
    ``block``.  With ``key`` (see :func:`global_rank`) the texts are read only when the batches are.
    """
    ranked = global_rank(df, order, "_rank", partitions, key)
    placed = ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).withColumn(
        "slot", (F.col("_rank") - 1) % size + 1
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("slot", block.alias("text")))), lambda x: x["text"])
    return placed.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), F.array_join(texts, "\n\n").alias("prompt")
    )
