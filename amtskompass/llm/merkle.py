"""Merkle manifest of a table: a hash tree over the rows of every group, and one over the groups.

The rows of a group stand in a total order and every ``ARITY`` consecutive nodes are hashed to their parent until one is
left (the group's subroot); the subroots of all groups, in order, give the root the same way.  A node is the SHA-256 of
its children's hex digests, so any row can be proved by the siblings on its way to the root.

Nothing is gathered by group.  Rows are numbered by a range partitioning and cut into aligned blocks of ``BLOCK`` rows,
however long their group is.  A block keeps each level of its tree as one hex string: fixed-width substrings of a level
are hashed to the next one, and what flanks a node within its run is the sibling segment.  The blocks' roots are the
nodes of the next tier, until a tier has one block for each group; the subroots then go through the same tiers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

ARITY = 3
BLOCK_LEVELS = 5
BLOCK = ARITY**BLOCK_LEVELS  # 243 nodes: a level is at most 15.5 KB
WIDTH = 64  # hex digits of a digest
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in a partition in the lower 33 bits
STEPS = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A value as text that cannot run into its neighbour: byte count, colon, value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values, in the given order."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold(start: Column, steps: Column) -> Column:
    """Root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level and from left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (from 0, within the group) and ``n`` (rows of the group).

    A range partitioning by group and order is frozen; a row's place is its place in the partition plus the group's rows
    in earlier partitions.  A long group is spread over many partitions; what is summed is one row for each
    group and partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = reliable_checkpoint(placed.withColumns({"_part": F.shiftright("_at", ROW_BITS), "_at": F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)}))
    by_group = Window.partitionBy("_g")
    counts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    totals = counts.select(
        "_g", "_p", "_first", F.sum("_n").over(by_group).alias("n"),
        F.coalesce(F.sum("_n").over(by_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    joined = placed.join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_g", "_p", "_first", "_before")


def _levels(level: str, depth: str) -> Column:
    """All levels of a block from its lowest one: every run of fixed-width substrings is hashed."""
    run = ARITY * WIDTH
    parents = f"array_join(transform(sequence(0, int((length(s) - 1) div {run})), i -> sha2(substring(s, i * {run} + 1, {run}), 256)), '')"
    up = f"concat(done, transform(slice(done, -1, 1), s -> {parents}))"
    return F.expr(f"aggregate(slice(sequence(1, {BLOCK_LEVELS}), 1, {depth}), array({level}), (done, j) -> {up})")


def _steps(levels: str, slot: str, depth: str) -> str:
    """SQL of the sibling segments of a slot: what flanks its ancestor within its run, for each level of the block."""
    own, first = f"({slot} div int(pow({ARITY}, j)))", f"({slot} div int(pow({ARITY}, j + 1)) * {ARITY})"
    left = f"substring({levels}[j], {first} * {WIDTH} + 1, ({own} - {first}) * {WIDTH})"
    right = f"substring({levels}[j], ({own} + 1) * {WIDTH} + 1, ({first} + {ARITY - 1} - {own}) * {WIDTH})"
    return f"transform(slice(sequence(0, {BLOCK_LEVELS - 1}), 1, {depth}), j -> struct({left} AS left, {right} AS right))"


def _depth(n: str) -> str:
    """Levels above the lowest one in a block of a tier with ``n`` nodes in the group: fewer only where the group ends in it."""
    whens = " ".join(f"WHEN {n} <= {ARITY**k} THEN {k}" for k in range(BLOCK_LEVELS))
    return f"CASE {whens} ELSE {BLOCK_LEVELS} END"


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of a tier (``grp, pos, n, h`` and more): their members in order and their levels."""
    rest = [c for c in nodes.columns if c not in ("grp", "pos", "n")]
    member = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), *rest)
    held = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    held = held.withColumn("depth", F.expr(_depth("n"))).withColumn("level", F.array_join(F.col("members.h"), ""))
    return held.withColumn("levels", _levels("level", "depth")).drop("level")


def _roots(blocks: DataFrame) -> DataFrame:
    """Nodes of the next tier: the last level of each block."""
    return blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1).alias("h"))


def _tiers(nodes: DataFrame, longest: int) -> list[DataFrame]:
    """Blocks of all tiers, lowest first; in the last one every group has one block.  Stored, as each is read twice."""
    tiers = [reliable_checkpoint(_blocks(nodes))]
    while longest > BLOCK:
        longest = -(-longest // BLOCK)
        tiers.append(reliable_checkpoint(_blocks(_roots(tiers[-1]))))
    return tiers


def _opened(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Members ``m`` of the lowest tier with the steps up to the last tier's roots, continued by ``above``.

    ``above`` has ``grp``, ``pos`` (0: one root for each group), ``steps`` and ``ends`` (a struct that goes along).
    """
    for blocks in reversed(tiers):
        upper = above.select(F.col("grp").alias("_g"), F.col("pos").alias("_b"), F.col("steps").alias("_up"), "ends")
        joined = blocks.join(upper, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
        own = F.expr(f"transform(members, m -> struct(m, {_steps('levels', 'm.slot', 'depth')} AS steps))")
        opened = joined.select("grp", "block", "ends", "_up", F.explode(own).alias("o"))
        above = opened.select("grp", (F.col("block") * BLOCK + F.col("o.m.slot")).alias("pos"), F.concat("o.steps", "_up").alias("steps"), "ends", F.col("o.m").alias("m"))
    return above


def _last(tiers: list[DataFrame]) -> DataFrame:
    """``grp`` and ``h``: the last node of each group."""
    return tiers[-1].select("grp", F.element_at("levels", -1).alias("h"))


def manifest(rows: DataFrame, group: str, order: Sequence[str], digest: str) -> DataFrame:
    """The columns of ``rows`` with ``subroot``, ``root`` and ``steps`` (siblings from the leaf to the root).

    ``digest`` names the column of leaf digests (:func:`leaf`), ``order`` the columns that order a group.  Nulls come first
    in both; rows that agree in them are ordered by their digest, and it does not matter which of two equal leaves comes
    first.  A null group is a group.  An empty table gives an empty manifest.  Rows are read once; what ``rows`` carries is
    kept in the shared checkpoint folder, so hand over ids and digests, not the hashed values.
    """
    keys = [f"o{i}" for i in range(len(order))]
    kept = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != digest]).alias("row"), F.col(f"`{group}`").alias("grp"), F.col(f"`{digest}`").alias("h"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)],
        F.monotonically_increasing_id().alias("salt"),  # lets a range border fall between equal rows
    )
    nodes = numbered(reliable_checkpoint(kept), "grp", [*keys, "h", "salt"]).drop("salt", *keys)
    longest = nodes.agg(F.max("n")).first()[0] or 0
    tiers = _tiers(nodes, longest)
    tops = numbered(_last(tiers).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "h"), "grp", ["name"])
    top_tiers = _tiers(tops, tops.count())
    root = _last(top_tiers).select("grp", F.lit(0).alias("pos"), F.array().cast(STEPS).alias("steps"), F.struct(F.col("h").alias("root")).alias("ends"))
    of_group = _opened(top_tiers, root).select(
        F.col("m.name").alias("grp"), F.lit(0).alias("pos"), "steps", F.struct("ends.root", F.col("m.h").alias("subroot")).alias("ends")
    )
    proofs = _opened(tiers, of_group)
    return proofs.select("m.row.*", F.col("m.h").alias(digest), "ends.subroot", "ends.root", "steps")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def documents_manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Manifest of a table of documents, grouped by source and ordered by id: ``doc_id, leaf, subroot, root, steps, claimed``.

    ``claimed`` is a text that is said to be the document's; its leaf is carried along (null: the leaf itself) to be folded
    with the siblings.  Missing and null values, empty and long texts are hashed like any other; other columns are not read.
    """
    have = {c: F.col(f"`{c}`") if c in docs.columns else F.lit(None) for c in FIELDS}
    first = [have["doc_id"].cast("long"), have["source"], have["lang"], have["n_chars"].cast("long")]
    said = F.lit(None).cast("string") if claimed is None else F.when(~claimed.eqNullSafe(have["text"]), leaf(*first, claimed))
    rows = docs.select(first[0].alias("doc_id"), have["source"].cast("string").alias("source"), leaf(*first, have["text"]).alias("leaf"), said.alias("claimed"))
    return manifest(rows, "source", ["doc_id"], "leaf")


def verified(proofs: DataFrame) -> DataFrame:
    """Adds ``folded_root`` (from the claimed leaf, else the leaf) and ``verified`` (it is the root)."""
    folded = fold(F.coalesce("claimed", "leaf"), F.col("steps"))
    return proofs.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
