"""The latest clean answer of every page, kept across batches.

Files of fetches arrive in any order and any grouping.  What a page's row must say does not depend on it: the row is that of
folding all fetches one by one in the order of their times.  A keyed state holds for each page the clean fetches of the last
``horizon`` (time, hash, tag, title and address; no bodies) above a base to which older ones are folded by an
event-time timer.  A batch that changes what follows from them gives one row for the page: the latest clean fetch, when the page was
first seen, when its content last changed, and whether stored content has to be rewritten.  Failed and unmodified answers
change nothing.  Fetches that arrive later than the horizon behind the newest one are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.keys import content_hash
from ..operators.snapshots import classify_fetch, page_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAST = "at long, hash string, etag string, title string, url string"
BASE = PAST + ", known boolean, first long, changed long, sent string"
OUT = "service_key string, url string, title string, new_hash string, etag string, at long, first long, changed long, rewritten boolean"
NEVER = -1  # of a fetch without a time: older than all others


class Fetch(NamedTuple):
    at: int
    hash: str | None
    etag: str | None
    title: str | None
    url: str | None


class Base(NamedTuple):
    """What the fetches that are no longer kept, or the stored row, amount to; ``sent`` is what the last output said."""

    at: int | None = None
    hash: str | None = None
    etag: str | None = None
    title: str | None = None
    url: str | None = None
    known: bool = False
    first: int | None = None
    changed: int | None = None
    sent: str | None = None


def _value(v: Any) -> Any:
    return None if v is None or v != v else v


def winners(fetches: list[Fetch]) -> list[Fetch]:
    """One fetch for each time, in order; of several at one time the smallest tag counts, then the smallest hash."""
    best: dict[int, Fetch] = {}
    rank = lambda f: (f.etag is None, f.etag or "", f.hash or "", f.title or "", f.url or "")
    for f in fetches:
        if f.at not in best or rank(f) < rank(best[f.at]):
            best[f.at] = f
    return [best[at] for at in sorted(best)]


def folded(base: Base, past: list[Fetch]) -> Base:
    """Base after the fetches, taken one by one."""
    for f in past:
        new = not base.known or f.hash != base.hash
        base = base._replace(
            at=f.at, hash=f.hash, etag=f.etag if f.etag is not None else base.etag, title=f.title, url=f.url, known=True,
            first=base.first if base.known else f.at, changed=f.at if new else base.changed,
        )
    return base


class LatestClean(StatefulProcessor):
    def __init__(self, horizon_ms: int | None):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", BASE)
        self.past = handle.getListState("past", PAST)

    def _base(self) -> Base:
        return Base(*[_value(v) for v in self.base.get()]) if self.base.exists() else Base()

    def _past(self) -> list[Fetch]:
        return [Fetch(*[_value(v) for v in row]) for row in self.past.get()] if self.past.exists() else []

    def _keep(self, past: list[Fetch]) -> None:
        if past:
            self.past.put([tuple(f) for f in past])
        else:
            self.past.clear()

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        at, first = _value(row["at"]), _value(row["first"])
        self.base.update(tuple(Base(None if at is None else int(at), _value(row["hash"]), known=True, first=None if first is None else int(first))))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        base, past = self._base(), self._past()
        for part in rows:
            past += [Fetch(int(r[0]), *[_value(v) for v in r[1:]]) for r in part[["at", "hash", "etag", "title", "url"]].itertuples(index=False)]
        past = [f for f in winners(past) if base.at is None or f.at > base.at]
        if not past:
            return
        now = folded(base, past)
        content, whole = f"{now.hash}@{now.changed}", f"{now.hash}@{now.changed}@{now.at}@{now.first}@{now.etag}"
        sent = base.sent or ""
        stored = f"{base.hash}@{base.changed}" if base.known and not sent else sent.partition("|")[0]
        if sent.partition("|")[2] != whole:
            yield pd.DataFrame(
                {
                    "service_key": [key[0]], "url": [now.url], "title": [now.title], "new_hash": [now.hash], "etag": [now.etag],
                    "at": pd.array([now.at], dtype="Int64"), "first": pd.array([now.first], dtype="Int64"), "changed": pd.array([now.changed], dtype="Int64"),
                    "rewritten": [content != stored],
                }
            )
        self.base.update(tuple(base._replace(sent=f"{content}|{whole}")))
        self._keep(past)
        if self.horizon is not None:
            self.handle.registerTimer(max(past[0].at, 0) // 1000 + self.horizon)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Fold what has passed the horizon into the base; no output follows from it."""
        base, past = self._base(), self._past()
        border = timerValues.getCurrentWatermarkInMs()
        old = [f for f in past if max(f.at, 0) // 1000 + self.horizon <= border]
        if old:
            self.base.update(tuple(folded(base, old)))
            self._keep(past[len(old) :])
        if len(old) < len(past):
            self.handle.registerTimer(max(past[len(old)].at, 0) // 1000 + self.horizon)
        return iter(())

    def close(self) -> None:
        pass


def clean_fetches(landed: DataFrame) -> DataFrame:
    """Clean answers of known pages, parsed, without their bodies."""
    parsed = classify_fetch(landed.where("service_key is not null")).where(F.col("outcome") == "parsed")
    at = F.coalesce(F.unix_micros("fetched_at"), F.lit(NEVER))
    return parsed.select("service_key", "fetched_at", at.alias("at"), content_hash(F.col("content")).alias("hash"), "etag", "title", "url")


def stored_state(pages: DataFrame) -> DataFrame:
    """What a stored table says of each page, to begin the state with."""
    return pages.where("service_key is not null").select(
        "service_key", F.unix_micros("last_fetched_at").alias("at"), F.unix_micros("created_at").alias("first"), F.col("content_hash").alias("hash")
    )


def latest_clean(landed: DataFrame, pages: DataFrame | None = None, horizon: str = "30 days") -> DataFrame:
    """Pages whose row follows differently from all fetches so far: ``service_key, url, title, new_hash, etag, fetched_at,
    first_at, changed_at, rewritten``.

    ``landed`` may be a stream (state and timers are kept between batches; needs the RocksDB state store) or a table of fetches, which
    is folded at once.  ``pages`` is the table before the first batch.
    """
    rows = clean_fetches(landed)
    spark = rows.sparkSession
    begin = None if pages is None else stored_state(pages).groupBy("service_key")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only store that such a state can live in
    if rows.isStreaming:
        span = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {horizon}) AS BIGINT) AS ms").first()["ms"]
        grouped, mode = rows.withWatermark("fetched_at", horizon).groupBy("service_key"), "EventTime"
    else:
        _ = spark.streams.active  # a session that never ran a stream has no coordinator of state stores yet
        span, grouped, mode = None, rows.groupBy("service_key"), "None"
    out = grouped.transformWithStateInPandas(LatestClean(span), OUT, "update", mode, begin)
    return out.select(
        "service_key", "url", "title", "new_hash", "etag", "rewritten",
        *[F.timestamp_micros(F.nullif(F.col(a), F.lit(NEVER))).alias(b) for a, b in (("at", "fetched_at"), ("first", "first_at"), ("changed", "changed_at"))],
    )


def diff_latest(pages: DataFrame, folded_rows: DataFrame) -> DataFrame:
    """Rows of :func:`latest_clean` as a diff against the stored pages."""
    stored = pages.select("service_key", F.col("id").alias("_old_id"), F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "inserted").when(F.col("rewritten"), "updated").otherwise("skipped")
    rows = folded_rows.join(stored, "service_key", "left")
    return rows.withColumns({"action": action, "outcome": F.lit("parsed"), "target_id": F.coalesce("_old_id", page_id(F.col("service_key")))}).drop("known", "_old_id")

