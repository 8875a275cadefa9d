"""Which anchors occur more than once in the whole table, told to the parts of the table that hold them.

Used by the substring operators.  Rows are dealt to *parts* by a hash of the row; every part is small enough for one
task.  Anchors (64-bit names) are dealt to *buckets* by their name.  What travels are arrays of names, not rows: an
anchor that occurs in several units of one flush is known to be shared there and then, so only one copy of it goes to
its bucket, and what the parts must be told goes straight to the bucket of the part.  A passage that a third of all
rows share therefore reaches its bucket once for each flush (16 MB of text), never once for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import all_pieces

FLUSH_BYTES = 16 << 20
PART_BYTES = 8 << 20  # text per part
PARTS_PER_BUCKET = 4
NOTES = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("parts", pa.binary())])
ANSWERS = pa.schema([("part", pa.int32()), ("keys", pa.binary())])


def layout(docs: DataFrame) -> tuple[int, int]:
    """Number of parts and of buckets, both in proportion to the bytes of text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(4, -(-total // PART_BYTES))
    return int(parts), int(max(1, parts // PARTS_PER_BUCKET))


def with_part(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id``, ``text`` and the part of each row: a hash of both, so copies of a text spread."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    )


def short_key(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, 32 bits of the name in the lower half: the more buckets, the longer the key."""
    bucket = (names >> np.uint64(32)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))


def _notes(keys: np.ndarray, units: np.ndarray, parts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What one flush tells: kind 0 seen in one unit, 1 known to be shared, 2 to be passed on to parts."""
    if not len(keys):  # only texts too short to have an anchor
        return
    order = np.lexsort((units, keys))
    keys, units, parts = keys[order], units[order], parts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    tail = np.append(head[1:], len(keys)) - 1
    many = units[head] != units[tail]
    rows: dict[str, list] = {"bucket": [], "kind": [], "keys": [], "parts": []}

    def add(kind: int, bucket: np.ndarray, key: np.ndarray, part: np.ndarray) -> None:
        by = np.argsort(bucket, kind="stable")
        bucket, key, part = bucket[by], key[by], part[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            if b > a:
                rows["bucket"].append(int(bucket[a]))
                rows["kind"].append(kind)
                rows["keys"].append((key[a:b] if kind == 2 else key[a:b].astype(np.uint32)).tobytes())
                rows["parts"].append(part[a:b].astype(np.uint32).tobytes())

    for kind, at in ((0, head[~many]), (1, head[many])):
        add(kind, (keys[at] >> np.uint64(32)).astype(np.int64), keys[at], parts[at])
    told = np.repeat(many, tail - head + 1)
    pairs = np.unique(np.stack((keys[told], parts[told].astype(np.uint64))), axis=1)
    add(2, (pairs[1] % np.uint64(buckets)).astype(np.int64), pairs[0], pairs[1])
    yield pa.RecordBatch.from_pydict(rows, schema=NOTES)


Anchors = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def shared_anchors(rows: DataFrame, anchors: Anchors, buckets: int) -> DataFrame:
    """``part``, ``keys``: the keys in that part whose anchor occurs in two or more units anywhere.

    ``anchors`` gives for a piece of rows the names, the unit of each (what must differ for an anchor to count as
    shared) and the row's index in the piece.
    """

    def note(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = unit0 = 0
        for piece in all_pieces(batches):
            names, units, at = anchors(piece)
            part = piece.column("part").to_numpy(zero_copy_only=False)
            held.append((short_key(names, buckets), units + unit0, part[at]))
            unit0 += int(units.max()) + 1 if len(units) else 0
            size += piece.nbytes
            if size >= FLUSH_BYTES:
                yield from _notes(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held, size, unit0 = [], 0, 0
        if held:
            yield from _notes(*map(np.concatenate, zip(*held, strict=True)), buckets)

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)
        keys = [np.frombuffer(v, dtype=np.uint64 if k == 2 else np.uint32).astype(np.uint64) for v, k in zip(table.column("keys").to_pylist(), kind, strict=True)]
        parts = [np.frombuffer(v, dtype=np.uint32) for v in table.column("parts").to_pylist()]
        own = [i for i, k in enumerate(kind) if k < 2]
        out_keys = [keys[i] for i, k in enumerate(kind) if k == 2]
        out_parts = [parts[i] for i, k in enumerate(kind) if k == 2]
        if own:
            key = np.concatenate([keys[i] for i in own]) | bucket
            part = np.concatenate([parts[i] for i in own])
            sure = np.concatenate([np.full(len(keys[i]), kind[i] == 1) for i in own])
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            known = np.bincount(inverse, weights=sure) > 0
            hit = ((count > 1) | known)[inverse]
            out_keys.append(key[hit])
            out_parts.append(part[hit])
        key, part = np.concatenate(out_keys), np.concatenate(out_parts)
        order = np.argsort(part, kind="stable")
        key, part = key[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        spans = [(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True) if b > a]
        return pa.table({"part": [int(part[a]) for a, _ in spans], "keys": [np.unique(key[a:b]).tobytes() for a, b in spans]}, schema=ANSWERS)

    notes = rows.mapInArrow(note, "bucket int, kind tinyint, keys binary, parts binary")
    return notes.groupBy("bucket").applyInArrow(answer, "part int, keys binary")


def joined(values: Iterable[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=dtype)
