"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each row of the stored table is one shard (about 2 MB of text) with the names of
its words, sorted, and for each word the positions at which it stands.  It is built once, holds every word of every
document, and is written to the shared checkpoint folder.  Test items come in blocks of bounded size; a block
is broadcast.  One pass over the index's word columns counts how often the block's terms occur in the whole table.
Then, for every window of 13 item words, each shard takes the posting list of the rarest term, shifts it by the
term's offset in the window, and intersects it with the shifted lists of the other terms in order of rarity.
Proximity starts from the rarest term of each item likewise: items whose rarest term a shard does not hold cost it nothing.

``matches`` returns what was found, one row for each document, item, kind and place; ``contamination`` judges documents by
the same hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ALNUM, Block, Words, all_pieces, covered, lookup, text_bytes

WINDOW = 13
BLOCK_WORDS = 2_000_000  # words of test items that are broadcast at once: 8 bytes of name, 13 of order and 18 of window each, 78 MB
ROWS_AT_ONCE = 1 << 16  # windows put in order at a time
NEAR_TERMS = 4  # rarest terms of an item that must stand near each other for a proximity match
SLOP = 20
INDEX = "shard long, doc_id array<long>, text_hash array<long>, n_words array<long>, terms binary, counts binary, places binary"
HITS = "shard long, at int, start binary, length binary, item binary, near binary, ids array<string>"
MATCHES = "doc_id long, text_hash long, item_id string, kind string, start long, length int"
OUT = "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


def shared_folder(spark) -> str:
    """Folder that the driver and all executors share, as the cluster names it."""
    from ..session import reliable_checkpoint

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.getCheckpointDir() is None:
            reliable_checkpoint(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def build_index(docs: DataFrame) -> DataFrame:
    """Stored index of ``docs``; see ``INDEX``.  ``terms`` are 8-byte names, ``counts`` and ``places`` 4-byte numbers."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in all_pieces(batches):
            texts = [t.lower() for t in text_bytes(piece.column("text"))]
            words = Words.of(Block.of(texts), ALNUM)
            names = words.names()
            order = np.argsort(names, kind="stable")
            terms, counts = np.unique(names[order], return_counts=True)
            ids = piece.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": [ids],
                    "text_hash": [piece.column("text_hash").to_pylist()],
                    "n_words": [np.diff(words.first).tolist()],
                    "terms": [terms.tobytes()],
                    "counts": [counts.astype(np.uint32).tobytes()],
                    "places": [order.astype(np.uint32).tobytes()],
                },
                schema=pa.schema([("doc_id", pa.list_(pa.int64())), ("text_hash", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())]),
            )

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    shards = rows.mapInArrow(index, INDEX.removeprefix("shard long, ")).withColumn("shard", F.monotonically_increasing_id())
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    shards.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Queries:
    """Windows of one block of test items as arrays."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        words = Words.of(Block.of([t.encode().lower() for _, t in items]), ALNUM)
        self.ids = [i for i, _ in items]
        self.names, self.first = words.names(), words.first
        self.vocabulary = np.unique(self.names)
        size = np.diff(words.first)
        many = np.where(size >= window, size - window + 1, np.minimum(size, 1))
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), many)
        self.start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + words.first[self.item]
        self.length = np.minimum(size, window)[self.item].astype(np.int16)
        self.offset = np.int8 if window < 128 else np.int16
        self.order = np.zeros((len(self.item), window), dtype=self.offset)
        self.rare = np.zeros((0, NEAR_TERMS), dtype=np.uint64)
        self.rare_item = self.rare_many = np.zeros(0, dtype=np.int32)

    def by_frequency(self, frequency: np.ndarray) -> None:
        """Order each window's terms, and choose each item's proximity terms, from the rarest."""
        if not len(self.names):
            return
        of = frequency[np.searchsorted(self.vocabulary, self.names)]
        offset = np.arange(self.order.shape[1])
        for a in range(0, len(self.item), ROWS_AT_ONCE):  # the numbers to sort are eight times as wide as the order
            part = slice(a, a + ROWS_AT_ONCE)
            at = np.minimum(self.start[part, None] + offset, len(of) - 1)
            cost = np.where(offset < self.length[part, None], of[at], np.iinfo(np.int64).max)
            self.order[part] = np.argsort(cost, axis=1, kind="stable").astype(self.offset)
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        first = np.lexsort((np.arange(len(item)), self.names, item))  # each item's distinct terms, at their first place
        fresh = np.append(True, (np.diff(item[first]) > 0) | (self.names[first][1:] != self.names[first][:-1]))
        first = first[fresh]
        first = first[np.lexsort((first, of[first], item[first]))]
        begin = np.flatnonzero(np.append(True, np.diff(item[first]) > 0))
        many = np.diff(np.append(begin, len(first)))
        place = np.arange(len(first)) - np.repeat(begin, many)
        row = np.repeat(np.arange(len(begin)), many)
        few = place < NEAR_TERMS
        self.rare = np.zeros((len(begin), NEAR_TERMS), dtype=np.uint64)
        self.rare[row[few], place[few]] = self.names[first[few]]
        self.rare_item, self.rare_many = item[first[begin]].astype(np.int32), np.minimum(many, NEAR_TERMS).astype(np.int32)


class Shard:
    """Posting lists of one stored row."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes, n_words: list[int]):
        self.terms = np.frombuffer(terms, dtype=np.uint64)
        self.count = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.places = np.frombuffer(places, dtype=np.uint32).astype(np.int64)
        self.sorted = (np.repeat(np.arange(len(self.terms)), self.count) << 32) | self.places
        self.first = np.append(0, np.cumsum(np.array(n_words, dtype=np.int64)))

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``term`` (indices) and where, for all their postings."""
        many = self.count[term]
        which = np.repeat(np.arange(len(term)), many)
        return which, self.places[np.repeat(self.begin[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]

    def phrases(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur and the place where each begins."""
        if not len(q.item) or not len(self.places):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        known = lookup(q.names, self.terms)
        rarest = known[q.start + q.order[:, 0]]
        windows = np.flatnonzero(rarest >= 0)
        which, place = self.postings(rarest[windows])
        window = windows[which]
        begin = place - q.order[window, 0]
        ok = (begin >= 0) & (begin + q.length[window] <= len(self.places))
        window, begin = window[ok], begin[ok]
        for k in range(1, q.order.shape[1]):
            if not len(window):
                break
            offset = q.order[window, k]
            due = k < q.length[window]
            term = known[np.minimum(q.start[window] + offset, len(q.names) - 1)]
            key = (np.maximum(term, 0) << 32) | (begin + offset)
            at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            ok = ~due | ((term >= 0) & (self.sorted[at] == key))
            window, begin = window[ok], begin[ok]
        ok = self.text_of(begin) == self.text_of(begin + q.length[window] - 1)
        return window[ok], begin[ok]

    def near(self, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Items and places where an item's rarest term stands with its other rare terms within ``slop`` words, in one text."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.places) or not len(q.rare):
            return none, none
        known = lookup(q.rare.ravel(), self.terms).reshape(q.rare.shape)
        due = np.arange(q.rare.shape[1]) < q.rare_many[:, None]
        rows = np.flatnonzero(((known >= 0) | ~due).all(axis=1))
        which, place = self.postings(known[rows, 0])
        row, text = rows[which], self.text_of(place)
        for k in range(1, q.rare.shape[1]):
            low = np.maximum(place - slop, self.first[text])
            high = np.minimum(place + slop, self.first[text + 1] - 1)
            term = known[row, k]
            found = np.minimum(np.searchsorted(self.sorted, (np.maximum(term, 0) << 32) | low), len(self.sorted) - 1)
            ok = ~due[row, k] | ((self.sorted[found] >> 32 == term) & ((self.sorted[found] & 0xFFFFFFFF) <= high))
            row, place, text = row[ok], place[ok], text[ok]
        return q.rare_item[row].astype(np.int64), place


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a bounded vocabulary occurs in the whole index."""
    known = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = lookup(np.frombuffer(terms, dtype=np.uint64), known.value)
                np.add.at(total, at[at >= 0], np.frombuffer(counts, dtype=np.uint32)[at >= 0])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": seen.tolist(), "n": total[seen].tolist()}, schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]))

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for row in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]  # at most one row for each word of the block
    return out


def _test_items(items: DataFrame) -> DataFrame:
    """Items that can match, each once by id and text."""
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where("item_id is not null and text is not null")
        .distinct()
    )


def _hits(index: DataFrame, items: DataFrame, window: int, slop: int, block_words: int) -> DataFrame:
    """What each text of the index holds of each block of items; see ``HITS``.

    ``start`` and ``length`` are the windows found and ``item`` the place in ``ids`` of each; ``near`` are pairs of a place in
    ``ids`` and a word.
    """
    spark = index.sparkSession
    tests = _test_items(items)
    words = tests.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0)).cast("long").alias("n")).first()["n"]
    blocks = max(1, -(-words // block_words))
    hits: DataFrame | None = None
    for b in range(blocks):
        block = [(r[0], r[1]) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]  # bounded by block_words
        queries = Queries(block, window)
        queries.by_frequency(_frequencies(index, queries.vocabulary))
        sent = spark.sparkContext.broadcast(queries)

        def match(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            for batch in batches:
                out: dict[str, list] = {c.split()[0]: [] for c in HITS.split(", ")}
                for row in batch.to_pylist():
                    shard = Shard(row["terms"], row["counts"], row["places"], row["n_words"])
                    found, begin = shard.phrases(q)
                    item, place = shard.near(q, slop)
                    text, by = shard.text_of(begin), shard.text_of(place)
                    order, near_order = np.argsort(text, kind="stable"), np.argsort(by, kind="stable")
                    found, begin, text, item, place, by = found[order], begin[order], text[order], item[near_order], place[near_order], by[near_order]
                    for t in np.union1d(text, by).tolist():
                        own = slice(*np.searchsorted(text, [t, t + 1]).tolist())
                        close = slice(*np.searchsorted(by, [t, t + 1]).tolist())
                        used, at = np.unique(np.concatenate((q.item[found[own]], item[close])), return_inverse=True)
                        many = own.stop - own.start
                        out["shard"].append(row["shard"])
                        out["at"].append(t)
                        out["start"].append((begin[own] - shard.first[t]).astype(np.int64).tobytes())
                        out["length"].append(q.length[found[own]].astype(np.int64).tobytes())
                        out["item"].append(at[:many].astype(np.int64).tobytes())
                        out["near"].append(np.stack((at[many:], place[close] - shard.first[t]), axis=1).astype(np.int64).tobytes())
                        out["ids"].append([q.ids[i] for i in used.tolist()])
                kinds = {"shard": pa.int64(), "at": pa.int32(), "ids": pa.list_(pa.string())}
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, kinds.get(c, pa.binary())) for c in out]))

        own = index.select("shard", "n_words", "terms", "counts", "places").mapInArrow(match, HITS)
        hits = own if hits is None else hits.unionByName(own)
    return hits


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every match: ``doc_id``, ``text_hash``, ``item_id``, ``kind``, ``start`` (word of the document, from 0) and ``length`` in words.

    Kind ``phrase``: an occurrence of a window of the item.  Kind ``near``: the place of the item's rarest term (length 1) with its
    other rare terms within ``slop`` words.  Rows of ``docs`` and ``items`` are treated as in ``contamination``; equal matches of
    windows that an item repeats are one row.
    """
    index = build_index(docs)
    hits = _hits(index, items, window, slop, block_words)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MATCHES.split(", ")]
        schema = pa.schema([("shard", pa.int64()), ("at", pa.int32()), *zip(names[2:], (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)])
        for batch in batches:
            for row in batch.to_pylist():
                at, start, length = (np.frombuffer(row[c], dtype=np.int64) for c in ("item", "start", "length"))
                near = np.frombuffer(row["near"], dtype=np.int64).reshape(-1, 2)
                found = np.unique(np.stack((at, np.zeros_like(at), start, length), axis=1), axis=0)
                close = np.unique(np.insert(near, 1, 1, axis=1), axis=0)
                every = np.concatenate((found, np.append(close, np.ones((len(close), 1), dtype=np.int64), axis=1)))
                for a in range(0, len(every), ROWS_AT_ONCE):
                    part = every[a : a + ROWS_AT_ONCE]
                    columns = [
                        np.full(len(part), row["shard"]), np.full(len(part), row["at"], dtype=np.int32), [row["ids"][i] for i in part[:, 0].tolist()],
                        [("phrase", "near")[k] for k in part[:, 1].tolist()], part[:, 2], part[:, 3].astype(np.int32),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = hits.mapInArrow(spread, "shard long, at int, " + MATCHES.split(", ", 2)[2]).distinct()
    held = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "text_hash")).alias("at", "row")).select("shard", "at", "row.doc_id", "row.text_hash")
    return rows.join(held, ["shard", "at"]).select(*[c.split()[0] for c in MATCHES.split(", ")])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: words hit by item windows, the items found, the verdict, and proximity matches.
    ``text_hash`` (XXH64 of the text) tells rows with the same ``doc_id`` apart.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.  A null text has no words; an item without
    words or without ``item_id`` is ignored; repeated items count once by id; repeated documents are separate rows.
    """
    index = build_index(docs)
    hits = _hits(index, items, window, slop, block_words)

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[dict]] = {}
        for r in right.to_pylist():
            found.setdefault(r["at"], []).append(r)
        out: dict[str, list] = {"doc_id": [], "text_hash": [], "n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": [], "n_near_items": []}
        for shard in left.to_pylist():
            for t, (doc, text_hash, n) in enumerate(zip(shard["doc_id"], shard["text_hash"], shard["n_words"], strict=True)):
                rows = found.get(t, [])
                names = sorted({r["ids"][i] for r in rows for i in set(np.frombuffer(r["item"], dtype=np.int64).tolist())})
                close = {r["ids"][i] for r in rows for i in set(np.frombuffer(r["near"], dtype=np.int64)[::2].tolist())}
                hit = 0
                if names:
                    start = np.concatenate([np.frombuffer(r["start"], dtype=np.int64) for r in rows])
                    length = np.concatenate([np.frombuffer(r["length"], dtype=np.int64) for r in rows])
                    marks = np.zeros(n, dtype=bool)
                    for size in np.unique(length).tolist():
                        marks |= covered(start[length == size], size, n)
                    hit = int(marks.sum())
                out["doc_id"].append(doc)
                out["text_hash"].append(text_hash)
                out["n_words"].append(n)
                out["n_hit"].append(hit)
                out["n_items"].append(len(names))
                out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
                out["contaminated"].append(hit > 0 and 20 * hit >= n)
                out["n_near_items"].append(len(close))
        kinds = {"items_sha256": pa.string(), "contaminated": pa.bool_()}
        return pa.table(out, schema=pa.schema([(c, kinds.get(c, pa.int64())) for c in out]))

    return index.select("shard", "doc_id", "text_hash", "n_words").groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(judge, OUT)
