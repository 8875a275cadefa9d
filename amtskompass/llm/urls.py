"""URL filter with a path-template tree.

Rules over host suffixes and path prefixes come first.  What no rule covers is judged by the template of its path.  Per
host, level by level, a segment that looks variable (a number, a date, a hash, a mixed identifier) or whose place under its parent takes too many
values becomes a wildcard; other segments stay.  Then the tree is merged from its leaves up: at each level, branches that differ in this
segment only, and whose shares of bad pages do not differ significantly from that of all of them together, become one wildcard
branch.  A template is rejected when its smoothed share of bad labelled pages reaches the threshold.  Both passes go as deep as
the longest path.

Pages are first reduced to distinct (host, path) with counts, so the levels work on paths, not on pages.  Levels are aggregations with partial
sums and equi joins; a host with a third of all pages is just many paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed
from ..session import reliable_checkpoint, shared_folder

# Fixed values: (verdict, host suffix, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MANY = 20  # distinct values under one parent from which a place may be variable
VARIED = 0.5  # ... when at least this share of its pages have values of their own
Z = 1.96  # branches whose share of bad pages differs by less are similar
PRIOR_PAGES, THRESHOLD = 4.0, 0.5
WILD = "*"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Longest rule that fits (as ``host + path``) and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _looks_variable(segment: Column) -> Column:
    bare = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}\z", "")
    return (
        bare.rlike(r"\A[0-9]+\z")
        | bare.rlike(r"\A[0-9]{4}[-_.][0-9]{1,2}([-_.][0-9]{1,2})?\z")
        | bare.rlike(r"(?i)\A(?=.*[0-9])[0-9a-f-]{8,}\z")
        | bare.rlike(r"(?i)\A(?=.*[0-9].*[0-9])[0-9a-z_-]{12,}\z")
        | (F.length(bare) > 40)
    )


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (``host``, ``path``, counts) with their generalised ``template``; one round for each level of the deepest path."""
    now = paths.withColumns({"segments": F.filter(F.split("path", "/"), lambda s: s != ""), "template": F.lit("")})
    deepest = now.agg(F.coalesce(F.max(F.size("segments")), F.lit(0)).alias("n")).first()["n"]
    for level in range(deepest):
        now = computed(now.withColumn("own", F.get("segments", F.lit(level))), {"variable": F.coalesce(_looks_variable(F.col("own")), F.lit(False))})
        values = now.where("own is not null and not variable").groupBy("host", "template", "own").agg(F.sum("pages").alias("pages"))
        places = values.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("pages").alias("pages"))
        wild = places.where((F.col("kinds") >= MANY) & (F.col("kinds") >= VARIED * F.col("pages"))).select("host", "template", F.lit(True).alias("many"))
        wild = reliable_checkpoint(wild)  # a stored side lets Spark split the other one at a hot parent
        now = now.join(wild, ["host", "template"], "left")
        step = F.when(F.col("variable") | F.coalesce("many", F.lit(False)), WILD).otherwise(F.col("own"))
        now = now.withColumn("template", F.when(F.col("own").isNotNull(), F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))).drop("own", "variable", "many")
        now = reliable_checkpoint(now)
    return now.drop("segments")


def _stored(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read again.  A checkpoint would keep what the optimiser infers about them, which
    multiplies from level to level."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/branches-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def merged_templates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``host``, ``template``, ``labelled``, ``bad``) with ``merged``, the template after merging from the leaves up.

    A family are the branches of a host that agree in all segments but the one at the level; a branch without labelled pages
    is like its family.
    """
    now = leaves.withColumn("merged", F.col("template"))
    steps = F.split("merged", "/")  # the first one is empty
    deepest = now.agg(F.coalesce(F.max(F.size(steps) - 1), F.lit(0)).alias("n")).first()["n"]
    for level in range(deepest, 0, -1):
        branches = now.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).where(F.size(steps) > level)
        above = F.array_join(F.slice(steps, 1, level), "/")
        below = F.array_join(F.slice(steps, F.lit(level + 2), F.size(steps)), "/")
        deeper = F.size(steps) > level + 1  # an empty rest and no rest are different
        branches = _stored(computed(branches, {"above": above, "below": below, "deeper": deeper}))
        family = branches.groupBy("host", "above", "below", "deeper").agg(F.count(F.lit(1)).alias("kinds"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        family = _stored(family.where("kinds > 1"))  # a stored side lets Spark split the other one at a hot parent
        share = F.try_divide("all_bad", "all_labelled")
        spread = F.sqrt(F.try_divide(F.greatest(share * (1 - share), F.lit(1e-4)), F.col("labelled")))
        similar = (F.col("labelled") == 0) | (F.abs(F.try_divide("bad", "labelled") - share) < Z * spread)
        joined = F.concat("above", F.lit(f"/{WILD}"), F.when(F.col("deeper"), F.concat(F.lit("/"), "below")).otherwise(""))
        changed = branches.join(family, ["host", "above", "below", "deeper"]).where(similar).select("host", "merged", joined.alias("wild"))
        now = _stored(now.join(changed, ["host", "merged"], "left").withColumn("merged", F.coalesce("wild", "merged")).drop("wild"))
    return now


def judged_templates(rows: DataFrame, prior_pages: float = PRIOR_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """``host``, ``template``, ``merged`` (the branch it was merged into) and ``rejected``."""
    leaves = rows.groupBy("host", "template").agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = leaves.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    prior = (total["b"] + 1.0) / (total["l"] + 2.0) if total["l"] else 0.0
    branches = merged_templates(reliable_checkpoint(leaves))
    pure = branches.groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    pure = pure.select("host", "merged", ((F.col("b") + prior_pages * prior) / (F.col("l") + prior_pages) >= threshold).alias("rejected"))
    return branches.select("host", "template", "merged").join(reliable_checkpoint(pure), ["host", "merged"])


def filtered(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of ``pages`` (``page_id``, ``url``): ``host``, ``path``, ``rule``, ``verdict``, ``template``.

    ``labels`` (``page_id``, ``bad`` 0 or 1) may cover any part of the pages; several labels of a page all count.  A null url or one
    without ``://`` has an empty host and path and is judged as one template of the empty host; repeated rows are judged
    alike; without any label nothing is rejected but by rule.
    """
    host, path = parts(F.col("url").cast("string"))
    rows = computed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), {"host": host, "path": path}).drop("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = computed(rows, {"rule": rule, "ruled": verdict})
    marked = labels.where("page_id is not null").groupBy("page_id").agg(F.count("bad").alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    paths = (
        rows.join(marked, "page_id", "left")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    tree = templates(paths)
    verdicts = reliable_checkpoint(judged_templates(tree))
    known = tree.select("host", "path", "template").join(verdicts, ["host", "template"])
    return rows.join(known.select("host", "path", "merged", "rejected"), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), F.col("merged").alias("template")
    )
