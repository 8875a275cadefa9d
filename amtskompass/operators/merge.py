"""Set-based merges: upsert, delist, semi-join updates, exclusions and dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from .ranking import first_by

# --- fixed values: defaults of inserted rows --------------------------------------
INSERT_DEFAULTS = {"view_count": 0, "attempts": 0, "priority": 0, "max_attempts": 3}
MAX_BULK_IDS = 500  # of one request


def with_unique_keys(updates: DataFrame, key: str) -> DataFrame:
    """Updates that fail at run time when a key occurs twice.

    A merge must not touch a row twice, so a duplicate is an error and never a silent choice.
    The check is a streaming window on the merge key: its shuffle and sort are the ones the
    following join needs anyway.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    error = F.raise_error(F.concat(F.lit("duplicate key in updates: "), F.col(key).cast("string")))
    return updates.withColumn("_nth", nth).where(F.when(F.col("_nth") > 1, error.cast("boolean")).otherwise(True)).drop("_nth")


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """Cast only when the types differ by more than nullability (which a cast may not tighten)."""
    return col if have.simpleString() == want.simpleString() else col.cast(want)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    as_of: str | None = None,
    preserve: Sequence[str] = (),
    unique: bool = False,
    mark: str | None = None,
    change: str | None = None,
) -> DataFrame:
    """New snapshot of ``target`` after merging ``updates`` on ``key``.

    Update columns overwrite; columns missing from the updates, and those named in
    ``preserve``, survive on existing rows.  Inserted rows get defaults.  ``updated_at``
    (and ``created_at`` of inserts) become ``as_of``.  Pass ``unique=True`` when the updates
    are already known to have unique keys; ``mark`` adds a flag that tells which rows they hit.

    ``change`` names a column of the updates that says insert, update or delete; then an update of a missing row, a deletion of
    one, and an insert of an existing row have no effect.
    """
    if not unique:
        updates = with_unique_keys(updates, key)
    cols = updates.columns
    renamed = updates.withColumnsRenamed({c: f"u_{c}" for c in cols})
    joined = target.join(renamed, F.col(key) == F.col(f"u_{key}"), "full_outer")
    is_update, is_insert = F.col(f"u_{key}").isNotNull(), F.col(key).isNull()
    if change:
        kind = F.coalesce(F.col(f"u_{change}"), F.lit(""))
        joined = joined.where(F.when(is_insert, kind == "insert").otherwise(kind != "delete"))
        is_update = is_insert | (kind == "update")
    stamp = F.lit(as_of).cast("timestamp") if as_of else None
    out: list[Column] = []
    types = {f.name: f.dataType for f in updates.schema}
    for field in target.schema:
        name = field.name
        old = F.col(name)
        new = as_type(F.col(f"u_{name}"), types[name], field.dataType) if name in cols else None
        if name == key:
            value = F.coalesce(old, new)
        elif new is not None:
            value = F.when(is_insert, new).otherwise(old) if name in preserve else F.when(is_update, new).otherwise(old)
        elif name == "updated_at" and stamp is not None:
            value = F.when(is_update, stamp.cast(field.dataType)).otherwise(old)
        elif name == "created_at" and stamp is not None:
            value = F.when(is_insert, stamp.cast(field.dataType)).otherwise(old)
        elif name in INSERT_DEFAULTS:
            value = F.when(is_insert, F.lit(INSERT_DEFAULTS[name]).cast(field.dataType)).otherwise(old)
        else:
            value = old
        out.append(value.alias(name))
    if mark:
        out.append(is_update.alias(mark))
    return joined.select(*out)


def reuse_slugs(updates: DataFrame, target: DataFrame, url: str = "official_url") -> DataFrame:
    """Incoming rows take the slug already stored for their url."""
    known = target.where(F.col(url).isNotNull()).select(F.col(url).alias("_url"), F.col("slug").alias("_slug"), "id")
    wanted = updates.select(F.col(url).alias("_url")).distinct()
    stored = first_by(known.join(wanted, "_url", "left_semi"), ["_url"], [F.col("id").desc_nulls_last()]).drop("id")
    return updates.join(stored, F.col(url) == F.col("_url"), "left").withColumn(
        "slug", F.coalesce("_slug", "slug")
    ).drop("_url", "_slug")


def exclude_existing(items: DataFrame, target: DataFrame, key: str, target_key: str | None = None) -> DataFrame:
    """Items whose key is not stored yet."""
    stored = target.select(F.col(target_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return items.join(stored, key, "left_anti")


def dedupe_first(df: DataFrame, key: str, order: Sequence[Column], drop_empty: bool = False) -> DataFrame:
    """First row per key; optionally without empty keys."""
    rows = df.where(F.coalesce(F.col(key), F.lit("")) != "") if drop_empty else df
    return first_by(rows, [key], order)


def delisted_keys(jobs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Active rows that the fetch did not return."""
    return jobs.where("is_active").select("refnr").join(
        fetched.select("refnr").distinct(), "refnr", "left_anti"
    )


def delist_missing(jobs: DataFrame, fetched: DataFrame, as_of: str, min_fetched: int = 0) -> DataFrame:
    """Deactivate active rows missing from the fetch.

    With ``min_fetched`` the step is skipped when fewer distinct keys were fetched, which
    guards against an empty fetch switching everything off.
    """
    keys = fetched.select("refnr").distinct()
    seen = keys.withColumn("_seen", F.lit(True))
    rows = jobs.join(seen, "refnr", "left")
    gone = F.col("is_active") & F.col("_seen").isNull()
    if min_fetched > 0:
        gone = gone & keys.agg(F.count(F.lit(1)) >= min_fetched).scalar()
    return rows.withColumns(
        {
            "is_active": F.when(gone, F.lit(False)).otherwise(F.col("is_active")),
            "updated_at": F.when(gone, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at")),
        }
    ).select(*jobs.columns)


def defer_activate(updates: DataFrame, active: DataFrame) -> DataFrame:
    """Updates are active only when their key is active already."""
    keys = active.where("is_active").select(F.col("refnr").alias("_active")).distinct()
    return (
        updates.join(keys, F.col("refnr") == F.col("_active"), "left")
        .withColumn("is_active", F.col("_active").isNotNull())
        .drop("_active")
    )


def bulk_status(df: DataFrame, ids: Sequence[str], status: str, most: int | None = MAX_BULK_IDS) -> DataFrame:
    """Rows of the given ids with their new status; unknown ids are ignored.

    ``most`` limits the ids of one request (None: no limit); for ids that stand in a table use ``set_status_where``.
    """
    wanted = [str(i) for i in ids if str(i)]
    if status not in C.POLICY_STATUSES:
        raise ValueError("Invalid status")
    if not wanted:
        raise ValueError("No policy ids provided.")
    if most is not None and len(wanted) > most:
        raise ValueError("Too many policies selected.")
    return df.where(F.col("id").isin(wanted)).withColumn("status", F.lit(status))


def with_count(rows: DataFrame, out: str = "count") -> DataFrame:
    """Rows with their number.  A scalar subquery counts them; no row is gathered."""
    return rows.withColumn(out, rows.agg(F.count(F.lit(1))).scalar())


def set_status_where(df: DataFrame, keys: DataFrame, status: str, key: str = "id") -> DataFrame:
    """Table form of the status update: the rows whose key is in ``keys`` get the status."""
    marked = keys.select(F.col(key).alias("_key")).distinct()
    rows = df.join(marked, F.col(key) == F.col("_key"), "left")
    return rows.withColumn("status", F.when(F.col("_key").isNotNull(), status).otherwise(F.col("status"))).drop("_key")


def delete_by(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def nullify_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Payload mapping of optional texts: empty becomes null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def mutate(target: DataFrame, changes: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    """Insert, update and delete rows by id in one pass.

    ``changes`` carries ``change`` (insert, update or delete) next to the payload columns;
    an update of a missing row and an insert of an existing one have no effect.
    """
    optional = [c for c in ("effective_at", "content_de_summary") if dict(changes.dtypes).get(c) == "string"]
    return upsert(target, nullify_empty(changes, optional), key, as_of, change="change")
