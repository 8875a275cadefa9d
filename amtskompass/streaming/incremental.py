"""Incremental delivery of fetched pages: new files in a landing folder become a new version of the page table.

The stream runs with ``availableNow``: it takes everything that arrived since the last run and stops.  A keyed state turns the
fetches into one row for each page that is independent of the order of the files (:mod:`latest`).  The page table and the
tag state are kept in growing hash buckets (:mod:`buckets`).  A micro-batch reads and rewrites only the buckets its keys fall
into; a manifest names for each bucket the version that wrote it.  A replayed batch (an executor or the driver was lost)
starts from the manifest before it and writes the same folders again, so the result does not depend on how often a
batch was tried.  Bucket files that no kept manifest names are deleted after each batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ranking import first_by
from ..operators.snapshots import apply_diff, classify_fetch, diff_pages, enqueue_changes, etag_gate, save_etags, stored_fetches
from ..sources.schemas import PAGE_STATE, POLICY_PAGE
from . import buckets as B
from .latest import diff_latest, latest_clean

LANDED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("service_key", "url", "etag", "body", "error")]
    + [T.StructField("status", T.IntegerType()), T.StructField("fetched_at", T.TimestampType())]
)
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "bucket")] + [T.StructField(n, T.LongType()) for n in ("version", "rows")]
)
Entries = dict[tuple[str, B.Bucket], B.Entry]
KEYS = {"pages": "service_key", "state": "url"}
SCHEMAS = {"pages": POLICY_PAGE, "state": PAGE_STATE}
KEPT_VERSIONS = 3  # manifests whose files stay: a replay needs the one before the last


@dataclass(frozen=True)
class PageTables:
    """Folders of one incremental page table under a shared root.

    The table begins with ``buckets`` buckets; one that holds more than ``split_rows`` rows is split when it is next written.
    """

    root: str
    buckets: int = 64
    split_rows: int = 1_000_000

    def folder(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/version={version}"

    def bucket(self, kind: str, version: int, bucket: str) -> str:
        return f"{self.folder(kind, version)}/bucket={bucket}"

    def queue(self, version: int) -> str:
        return self.folder("queue", version)

    @property
    def manifests(self) -> str:
        return f"{self.root}/manifests"


def _files(spark: SparkSession, path: str):
    """File system of a path and the path in it, through the cluster's own configuration."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, tables: PageTables) -> list[int]:
    """Versions with a manifest, oldest first."""
    fs, path = _files(spark, tables.manifests)
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path)) if fs.exists(path) else []


def entries_of(spark: SparkSession, tables: PageTables, version: int) -> Entries:
    """Every bucket that has rows: as many entries as the tables have buckets."""
    rows = spark.read.schema(MANIFEST).parquet(f"{tables.manifests}/version={version}").collect()
    return {(r["kind"], B.Bucket.named(r["bucket"])): B.Entry(r["version"], r["rows"]) for r in rows}


def manifest(spark: SparkSession, tables: PageTables, version: int) -> dict[tuple[str, str], int]:
    """For each bucket that has rows the version that wrote it."""
    return {(kind, b.name): e.version for (kind, b), e in entries_of(spark, tables, version).items()}


def _publish(spark: SparkSession, tables: PageTables, version: int, entries: Entries) -> None:
    rows = spark.createDataFrame([(k, b.name, e.version, e.rows) for (k, b), e in sorted(entries.items(), key=lambda x: x[0])], MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{tables.manifests}/version={version}")


def _read(spark: SparkSession, tables: PageTables, kind: str, entries: Entries, wanted: set[B.Bucket] | None = None) -> DataFrame:
    paths = [tables.bucket(k, e.version, b.name) for (k, b), e in sorted(entries.items(), key=lambda x: x[0]) if k == kind and (wanted is None or b in wanted)]
    return spark.read.schema(SCHEMAS[kind]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[kind])


def _write(tables: PageTables, kind: str, rows: DataFrame, version: int, into: list[B.Bucket]) -> Entries:
    """Write rows by bucket; the entries of the buckets that got rows."""
    done = B.write(rows, KEYS[kind], tables.buckets, into, tables.folder(kind, version), SCHEMAS[kind], version)
    return {(kind, b): e for b, e in done.items()}


def start(spark: SparkSession, tables: PageTables, pages: DataFrame, state: DataFrame) -> None:
    """First version (-1) of an existing page table and tag state."""
    entries: Entries = {}
    for kind, rows in (("pages", pages), ("state", state)):
        entries |= _write(tables, kind, rows, -1, B.fresh(spark, rows, tables.buckets, tables.split_rows))
    _publish(spark, tables, -1, entries)


def last_version(spark: SparkSession, tables: PageTables, before: int | None = None) -> int:
    """Newest published version, optionally older than ``before``."""
    return max(v for v in versions(spark, tables) if before is None or v < before)


def read_pages(spark: SparkSession, tables: PageTables, version: int | None = None) -> DataFrame:
    at = last_version(spark, tables) if version is None else version
    return _read(spark, tables, "pages", entries_of(spark, tables, at))


def read_state(spark: SparkSession, tables: PageTables, version: int | None = None) -> DataFrame:
    at = last_version(spark, tables) if version is None else version
    return _read(spark, tables, "state", entries_of(spark, tables, at))


def _merge(spark: SparkSession, tables: PageTables, batch: DataFrame, batch_id: int, diff_of: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Next version from the pages a batch is about: ``diff_of`` compares the touched pages and tags with it.

    The diff (without bodies) is kept for the four results taken from it.  Touched buckets that have grown too large are
    written as their children.
    """
    before = entries_of(spark, tables, last_version(spark, tables, before=batch_id))
    touched = {kind: B.touched(batch, key, tables.buckets, [b for k, b in before if k == kind]) for kind, key in KEYS.items()}
    entries = {e: v for e, v in before.items() if e[1] not in touched[e[0]]}

    def into(kind: str) -> list[B.Bucket]:
        sizes = {b: before[kind, b].rows if (kind, b) in before else 0 for b in touched[kind]}
        return [c for b, n in sizes.items() for c in B.children(tables.buckets, b, n, tables.split_rows)]

    pages = _read(spark, tables, "pages", before, touched["pages"])
    state = _read(spark, tables, "state", before, touched["state"])
    at = F.col("fetched_at")
    diff = diff_of(pages, state).persist()
    try:
        entries |= _write(tables, "pages", apply_diff(pages, diff, at), batch_id, into("pages"))
        tags = first_by(stored_fetches(diff).where("etag is not null and url is not null"), ["url"], [at.desc_nulls_last(), F.col("etag").asc()])
        entries |= _write(tables, "state", save_etags(state, tags), batch_id, into("state"))
        enqueue_changes(diff, at).write.mode("overwrite").parquet(tables.queue(batch_id))
        _publish(spark, tables, batch_id, entries)
    finally:
        diff.unpersist()
    drop_old(spark, tables)


def merge_batch(spark: SparkSession, tables: PageTables, batch: DataFrame, batch_id: int, full: bool = False) -> None:
    """Fold a table of fetches into the next version, without regard to fetches of other batches.

    Of several answers for a page the latest clean one counts, else the latest.  Tags are saved only for pages whose content is
    stored; times are those of the fetches.  Pages are parsed once.
    """
    clean = F.col("error").isNull() & (F.col("status") == 200) & (F.coalesce("body", F.lit("")) != "")
    latest = first_by(
        batch.where("service_key is not null"), ["service_key"], [F.coalesce(clean, F.lit(False)).desc(), F.col("fetched_at").desc_nulls_last(), F.col("etag").asc_nulls_last()]
    )
    _merge(spark, tables, batch, batch_id, lambda pages, state: diff_pages(pages, etag_gate(state, classify_fetch(latest).drop("body"), full), F.col("fetched_at")))


def merge_latest(spark: SparkSession, tables: PageTables, rows: DataFrame, batch_id: int) -> None:
    """Fold what the keyed state says of a batch's pages into the next version."""
    held = rows.persist()  # the state must not be asked twice
    try:
        if not held.isEmpty():  # a batch that only moves the clock, or repeats what is known, makes no version
            _merge(spark, tables, held, batch_id, lambda pages, state: diff_latest(pages, held))
    finally:
        held.unpersist()


def drop_old(spark: SparkSession, tables: PageTables, keep: int = KEPT_VERSIONS) -> None:
    """Delete manifests beyond the newest ``keep`` and the bucket files that none of these names."""
    every = versions(spark, tables)
    kept, gone = every[-keep:], every[:-keep]
    if not gone:
        return
    named = {(k, v, b) for at in kept for (k, b), v in manifest(spark, tables, at).items()}
    for old in gone:
        for (k, b), v in manifest(spark, tables, old).items():
            if (k, v, b) not in named:
                fs, path = _files(spark, tables.bucket(k, v, b))
                fs.delete(path, True)
        fs, path = _files(spark, f"{tables.manifests}/version={old}")
        fs.delete(path, True)


def run_available(
    spark: SparkSession, landing: str, tables: PageTables, checkpoint: str, files_per_batch: int = 1000, horizon: str = "30 days"
) -> StreamingQuery:
    """Start the stream over everything in the landing folder; it stops when all is processed.

    The state begins with the pages of the first version; fetches may arrive up to ``horizon`` late.
    """
    source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    begin = _read(spark, tables, "pages", entries_of(spark, tables, -1) if -1 in versions(spark, tables) else {})  # only the first batch reads it
    return (
        latest_clean(source, begin, horizon)
        .writeStream.foreachBatch(lambda batch, batch_id: merge_latest(batch.sparkSession, tables, batch, batch_id))
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
