"""Related items: exact top-k per item without comparing pairs.

Score of a pair: 3 for the same region, 3 for the same category, 2 for the same publisher,
1 for any shared group.  Candidates of an item are ranked by score, then date, then id.

All items with the same (region, category, publisher, groups) rank all other items alike,
so the work is done once per such *profile*:

1. Every profile keeps its newest k+1 items (a partial top-k before the shuffle, so a hot
   profile sends k+1 rows per task).  Older items of a profile are beaten by these wherever
   they could be candidates.  Only the survivors go on.
2. For every combination of attributes a *cell* holds its newest k+1 survivors.
3. A profile gathers the cells it belongs to and keeps its best k+1 candidates.  An item
   outside a cell's newest k+1 is beaten by k+1 members that score at least as much, so
   nothing is lost: the result is exact.
4. Items join their profile's short list, drop themselves and keep k.

Every group is bounded by k+1 rows per cell and a fixed number of cells per profile; no
step grows with the size of a region, category or publisher.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: weights of the shared attributes -------------------------------
WEIGHTS = {"region_name": 3, "category": 3, "publisher": 2, "target_groups": 1}


def _cells(groups: Column) -> Column:
    """Array of (mask, group) cells of a row: every attribute combination, once per group where used."""
    plain = ["region_name", "category", "publisher"]
    cells = []
    with_group = []
    for size in range(len(plain) + 1):
        for chosen in combinations(range(len(plain)), size):
            mask = sum(1 << i for i in chosen)
            if mask:
                cells.append(F.struct(F.lit(mask).alias("mask"), F.lit(None).cast("string").alias("group")))
            with_group.append(mask)
    own = F.array_distinct(F.coalesce(groups, F.array().cast("array<string>")))
    grouped = F.flatten(
        F.transform(
            own,
            lambda g: F.array(*[F.struct(F.lit(m + 8).alias("mask"), g.alias("group")) for m in with_group]),
        )
    )
    return F.concat(F.array(*cells), grouped)


def _explode_cells(df: DataFrame) -> DataFrame:
    """One row per cell; attributes outside the cell's combination are nulled so that cells compare equal."""
    rows = df.withColumn("cell", F.explode(_cells(F.col("target_groups"))))
    part = lambda bit, name: F.when(F.col("cell.mask").bitwiseAND(bit) > 0, F.col(name))
    rows = rows.withColumns(
        {
            "c_region": part(1, "region_name"),
            "c_category": part(2, "category"),
            "c_publisher": part(4, "publisher"),
            "c_group": F.col("cell.group"),
            "c_mask": F.col("cell.mask"),
        }
    ).drop("cell")
    # a missing attribute is equal to nothing, so cells that use one do not exist
    for bit, name in ((1, "c_region"), (2, "c_category"), (4, "c_publisher"), (8, "c_group")):
        rows = rows.where((F.col("c_mask").bitwiseAND(bit) == 0) | F.col(name).isNotNull())
    return rows


CELL_KEY = ["c_mask", "c_region", "c_category", "c_publisher", "c_group"]
PROFILE = ["region_name", "category", "publisher", "target_groups"]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which missing key parts match each other; keeps the left key columns."""
    renamed = right.withColumnsRenamed({c: f"r_{c}" for c in keys})
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(renamed, cond).drop(*[f"r_{c}" for c in keys])


def related(items: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` related rows of every row: ``id, related_id, score, rank``.

    ``items`` needs id, region_name, category, publisher, target_groups, published_at.
    """
    base = items.select(
        "id", "published_at", *PROFILE[:3], F.array_sort(F.array_distinct("target_groups")).alias("target_groups")
    )
    newest = Window.partitionBy(*CELL_KEY).orderBy(F.col("published_at").desc_nulls_last(), F.col("id"))
    own_newest = Window.partitionBy(*PROFILE).orderBy(F.col("published_at").desc_nulls_last(), F.col("id"))
    survivors = base.withColumn("rn", F.row_number().over(own_newest)).where(F.col("rn") <= k + 1).drop("rn")
    cell_top = (
        _explode_cells(survivors)
        .withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= k + 1)
        .select(*CELL_KEY, F.struct("id", "published_at", *PROFILE).alias("cand"))
        .groupBy(*CELL_KEY)
        .agg(F.collect_list("cand").alias("cands"))
    )
    profiles = survivors.select(*PROFILE).distinct()
    joined = _null_safe_join(_explode_cells(profiles), cell_top, CELL_KEY)
    cand = F.col("cand")
    score = sum(
        (F.when(cand[name] == F.col(name), weight).otherwise(0) for name, weight in WEIGHTS.items() if name != "target_groups"),
        F.lit(0),
    ) + F.when(F.arrays_overlap(cand["target_groups"], F.col("target_groups")), WEIGHTS["target_groups"]).otherwise(0)
    best = Window.partitionBy(*PROFILE).orderBy(
        F.col("score").desc(), F.col("cand.published_at").desc_nulls_last(), F.col("cand.id")
    )
    short_list = (
        joined.select(*PROFILE, F.explode("cands").alias("cand"))
        .dropDuplicates([*PROFILE, "cand"])
        .withColumn("score", score)
        .withColumn("rn", F.row_number().over(best))
        .where(F.col("rn") <= k + 1)
        .groupBy(*PROFILE)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "score", F.col("cand.id").alias("related_id")))).alias("list"))
    )
    others = F.slice(F.filter(F.col("list"), lambda x: x["related_id"] != F.col("id")), 1, k)
    return (
        _null_safe_join(base, short_list, PROFILE)
        .select("id", F.posexplode(others).alias("pos", "hit"))
        .select(
            "id",
            F.col("hit.related_id").alias("related_id"),
            F.col("hit.score").cast("bigint").alias("score"),
            (F.col("pos") + 1).cast("bigint").alias("rank"),
        )
    )
