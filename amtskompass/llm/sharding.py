"""Shards of even row counts that keep linked documents together: balanced label propagation.

Documents with equal texts are linked, through their text's digest and never as pairs.  Every row starts with a label drawn by
hash.  A group of copies is one unit, unless it is larger than a shard's share, when a hash of the row cuts it into as few units as
fit.  Rows meet their unit once, to tally their labels; the rounds then work on units, one row each.  In each round a waiting unit asks
for the label that most of its rows have among the shards that still have room for all of it (if none of its labels has, for another
shard), and is admitted while the shard's quota lasts, larger units first.  What is refused asks again, for its next best label;
rounds end when no unit waits that fits anywhere.  Each admits at least one unit for every shard asked.  Units without room for them are
given up: their rows fill holes like single ones.  The law is made exact at the end: what is above a shard's share fills the shards below theirs.

Ranks and running sums inside a shard never need one task for a shard: rows are counted in small cells, the few counts are summed up, and only
rows of one cell are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

SHARDS = 24
CELL_ROWS = 20_000  # rows numbered in one task at a time, on average
FILL = 0.9  # part of a shard's share that a unit of a larger group holds, on average


def _numbered(rows: DataFrame, order: list[str], cells: int, key: Column, out: str) -> DataFrame:
    """Gapless numbers from 0 within each ``order[0]``, following ``order[1:]`` and then the hash cell of ``key``."""
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(cells)).cast("int"))
    counts = rows.groupBy(*order, "_cell").agg(F.count(F.lit(1)).alias("_n"))  # shards x classes x cells rows
    before = Window.partitionBy(order[0]).orderBy(*order[1:], "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*order, "_cell").orderBy(F.xxhash64(key), "rid")
    return rows.join(offsets, [*order, "_cell"]).withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_cell", "_before")


def _settled(units: DataFrame, room: list[int], cells: int) -> DataFrame | None:
    """``unit``, ``to``: the shard of every unit that found room.  ``units`` has ``unit``, ``rows`` and ``labels`` (label to rows)."""
    shards = len(room)
    waiting, settled, r = units, None, 0
    while True:
        free = F.array(*[F.lit(n).cast("long") for n in room])
        choices = F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda k: F.struct(F.coalesce(F.col("labels")[k], F.lit(0).cast("long")).alias("n"), F.xxhash64("unit", k, F.lit(r)).alias("tie"), k.alias("shard")),
        )
        choice = F.array_max(F.filter(choices, lambda c: F.get(free, c["shard"]) >= F.col("rows")))
        asks = (
            waiting.withColumn("to", choice["shard"])
            .where("to is not null")
            .withColumn("size_class", -F.ceil(F.log2("rows")).cast("int"))
            .withColumn("cell", F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(cells)).cast("int"))
        )
        counts = asks.groupBy("to", "size_class", "cell").agg(F.sum("rows").alias("sum"))  # shards x classes x cells rows
        before = Window.partitionBy("to").orderBy("size_class", "cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
        within = Window.partitionBy("to", "size_class", "cell").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
        filled = F.col("before") + F.sum("rows").over(within)
        asked = reliable_checkpoint(
            asks.join(offsets, ["to", "size_class", "cell"]).select("unit", "rows", "labels", "to", (filled <= F.get(free, F.col("to"))).alias("admitted"))
        )
        given = asked.where("admitted").groupBy("to").agg(F.sum("rows").alias("n")).collect()  # at most one row for each shard
        if not given:
            return settled
        for row in given:
            room[row["to"]] -= row["n"]
        new = asked.where("admitted").select("unit", "to")
        settled = new if settled is None else settled.unionByName(new)
        waiting, r = asked.where("not admitted").drop("to", "admitted"), r + 1


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Law ``rows``: the counts of any two shards differ by one at most.  A null text is a text of no bytes and is linked to empty
    texts; repeated rows and rows without ``doc_id`` are documents of their own; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("digest"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = reliable_checkpoint(rows)  # freezes the row ids
    total = rows.count()
    share = max(1, total // shards)
    quota = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")  # exact number of rows of each shard
    cells = max(1, -(-share // CELL_ROWS)) * 2

    # a stored side lets Spark split the other one where a text has very many copies
    groups = reliable_checkpoint(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    pieces = F.when(F.col("copies") <= share, F.lit(1)).otherwise(F.ceil(F.col("copies") / (FILL * share)))
    state = (
        rows.join(groups, "digest", "left")
        .withColumn("unit", F.when(F.col("copies").isNotNull(), F.xxhash64("digest", F.pmod(F.xxhash64("rid"), pieces))))
        .withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(shards)).cast("int"))
        .select("rid", "doc_id", "size", "text_crc32", "unit", "shard")
    )
    state = reliable_checkpoint(state)
    tally = state.where("unit is not null").groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"))
    labels = F.map_from_entries(F.collect_list(F.struct("shard", "n")))  # one entry for each shard at most
    units = reliable_checkpoint(tally.groupBy("unit").agg(F.sum("n").alias("rows"), labels.alias("labels")))
    settled = _settled(units, [total // shards + (k < total % shards) for k in range(shards)], cells)
    placed = state.where("unit is null").select("rid", "shard", F.lit(1).alias("class"))
    linked = state.where("unit is not null").select("rid", "unit", "shard")
    if settled is not None:
        found = F.col("to").isNotNull()
        linked = linked.join(reliable_checkpoint(settled), "unit", "left").withColumn("shard", F.coalesce("to", "shard")).withColumn("class", F.when(found, 0).otherwise(1))
        placed = placed.unionByName(linked.select("rid", "shard", "class"))
    else:
        placed = placed.unionByName(linked.select("rid", "shard", F.lit(1).alias("class")))
    ranked = reliable_checkpoint(_numbered(placed, ["shard", "class"], cells, F.col("rid"), "rank").withColumn("over", F.col("rank") >= quota))

    kept = ranked.where("not over").select("rid", "shard", F.col("rank").alias("slot"))
    spare = ranked.where("over").select("rid", F.lit(0).alias("all"))
    numbered = _numbered(spare, ["all"], cells * shards, F.col("rid"), "number").select("rid", "number")
    loads = kept.groupBy("shard").agg(F.count(F.lit(1)).alias("have"))
    have = {r["shard"]: r["have"] for r in loads.collect()}  # one row for each shard
    holes, begin = [], 0
    for k in range(shards):
        room = total // shards + (k < total % shards) - have.get(k, 0)
        if room:
            holes.append((k, have.get(k, 0), begin))
            begin += room
    at = F.lit(-1)
    for _, _, first in holes:
        at = at + (F.col("number") >= first).cast("int")
    chosen = [F.element_at(F.array(*[F.lit(h[i]) for h in holes] or [F.lit(0)]), at + 1) for i in range(3)]
    filled = numbered.select("rid", chosen[0].cast("int").alias("shard"), (chosen[1] + F.col("number") - chosen[2]).cast("long").alias("slot"))
    return state.select("rid", "doc_id", "size", "text_crc32").join(kept.unionByName(filled), "rid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
