"""SimHash near-dedup: fingerprints, tiled exact comparison, connected components.

A fingerprint is computed where the text is read (numpy on the XXH64 of each shingle).  Equal fingerprints are one
node.  The nodes are laid out in tiles of equal bit counts, and tiles are compared in pairs by exclusive-or and bit
counts.  Two fingerprints at distance d have bit counts that differ by d at most, in total and summed over the
quarters of each word as well, so tile pairs whose counts differ beyond the radius are skipped.  A tile pair gives at most one link for
each of its nodes (a spanning forest of the links it finds), so dense groups never become all their pairs.  Components
come from Spark rounds of large and small stars on the links.

Where a similarity is asked for (``first_of_each``), only sets that share a shingle of their prefixes are compared at all: shingles have
one order in the whole table, the widespread ones last, and two sets as similar as that share one of the first few of either.
Among these, fingerprints of the distinct shingles find candidates, within a wide radius.  The shingle sets of each candidate
component are then compared exactly, in pairs of chunks of bounded size, and only pairs that reach the similarity are links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .blocks import NOT_SPACE, Block, Words, all_pieces, gram_names, lookup, mix, text_bytes
from .shared import FLUSH_BYTES, joined

SEED = 42
TILE = 8192  # fingerprints in a tile on average, at most
CELLS = 1 << 21  # comparisons at once
CHUNK_SETS, CHUNK_NAMES = 512, 1 << 18  # shingle sets, and shingles in them, of a chunk on average
NAME_BYTES = 5  # of a shingle's name that travel to be compared: two different shingles of a pair of sets agree with odds of 2**-40
DEVIATIONS = 5.0  # candidates differ by the bits expected at the similarity and this many deviations
COMMON = 1 << 20  # widespread shingles that all tasks know, at most
BUCKET_SHINGLES = 4 << 20  # shingles of the table, for each bucket that gathers prefixes
BLOCK_SETS = 4096  # sets that share a shingle of their prefixes and are compared at once


def shingle_names(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip((ends - size).tolist(), ends[k - 1 :].tolist(), strict=False)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int, lanes: int) -> bytes:
    """Big-endian fingerprint of 64 bits for each lane; zero without words.

    The first lane counts the bits of the shingles' XXH64 (seed 42), further lanes those of numbers mixed from it.
    """
    return _majority(shingle_names(text, shingle), lanes)


def _majority(names: np.ndarray, lanes: int) -> bytes:
    if not len(names):
        return bytes(8 * lanes)
    out = []
    for lane in range(lanes):
        own = (names if lane == 0 else mix(names + np.uint64(lane))).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), 255):  # 255 ones fit into a byte
            ones += np.unpackbits(own[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
        out.append(np.packbits(2 * ones > len(names)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (binary) of every row; a null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle, lanes) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, type=pa.binary())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp binary")


def _words(values: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=">u8").astype(np.uint64).reshape(-1, lanes)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """For each row of ``a`` and then of ``b``: the smallest row it is linked to through this pair of tiles."""
    n = len(a) + len(b)
    label = np.arange(n)
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        apart = np.bitwise_count(a[at : at + step, None, 0] ^ b[None, :, 0])
        for lane in range(1, a.shape[1]):
            apart = apart + np.bitwise_count(a[at : at + step, None, lane] ^ b[None, :, lane])
        i, j = np.nonzero(apart <= radius)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        j = j if same else j + len(a)
        while len(i):
            x, y = label[i], label[j]
            open_ = x != y
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            if not len(i):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def links(nodes: DataFrame, radius: int, lanes: int = 1, tile: int = TILE) -> DataFrame:
    """``a``, ``b``: links between different fingerprints (column ``fp``, no repeats) that connect the same
    components as all pairs within ``radius`` bits do."""
    quarters = 4 if radius <= 4 else 1  # finer bit counts skip more, but more tiles are neighbours of each
    width = 64 * lanes // quarters
    hexed = F.hex("fp")
    counts = []
    for k in range(quarters):
        digits = F.substring(hexed, k * width // 4 + 1, width // 4)
        words = [F.conv(F.substring(digits, d + 1, min(16, width // 4)), 16, -10).cast("long") for d in range(0, width // 4, 16)]
        counts.append(sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("int"))
    grain = max(1, radius // 3) if quarters == 1 else 1  # a wide radius leaves few classes to skip: make them coarser
    reach = -(-radius // grain)
    placed = nodes.select("fp", F.array(*[F.floor(c / grain).cast("int") for c in counts]).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    tiles = (
        placed.join(sizes, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)).cast("int"))
        .groupBy("cell", "chunk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = reliable_checkpoint(tiles)
    near = [o for o in product(range(-reach, reach + 1), repeat=quarters) if sum(map(abs, o)) <= reach and o >= (0,) * quarters]
    steps = F.array(*[F.array(*[F.lit(x) for x in o]) for o in near])
    left = tiles.select(F.col("cell").alias("from"), F.col("chunk").alias("i"), F.col("fps").alias("a"), F.explode(F.transform(steps, lambda o: F.zip_with("cell", o, lambda x, y: x + y))).alias("cell"))
    named = left.join(tiles.select("cell", "chunk"), "cell").where((F.col("from") != F.col("cell")) | (F.col("i") <= F.col("chunk")))
    pairs = named.join(tiles, ["cell", "chunk"]).select("a", F.col("fps").alias("b"), ((F.col("from") == F.col("cell")) & (F.col("i") == F.col("chunk"))).alias("same"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, same = (batch.column(c)[k].as_py() for c in range(3))
                label = _forest(_words(a, lanes), _words(b if not same else a, lanes), same, radius)
                both = a if same else a + b
                linked = np.flatnonzero(label[: len(both)] != np.arange(len(both))).tolist()
                if linked:
                    yield pa.RecordBatch.from_pydict({"a": [both[i] for i in linked], "b": [both[i] for i in label[linked].tolist()]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return pairs.mapInArrow(compare, "a binary, b binary")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node``, ``root``: the smallest node of each component, for every node that has a link.

    Large and small stars alternate (each an aggregation and a join) until the links no longer change; the number of
    rounds grows with the logarithm of the longest chain, ``rounds`` only guards against a fault.
    """
    now = reliable_checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        stamp = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if stamp == state or stamp[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = stamp
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a stored side lets Spark split the other one at a node with very many links
        least = reliable_checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = reliable_checkpoint(small.where("u <> v").distinct())
    raise RuntimeError(f"links still changed after {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, lanes: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``root``, ``component_id``: one row for each row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius`` differing bits.  A null text has no
    words; rows without words have fingerprint zero and are linked like others; a null ``doc_id`` is never the smallest (the component
    is null if it has no other); repeated rows share their component.
    """
    rows = reliable_checkpoint(fingerprints(docs, shingle, lanes))
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(links(groups.select("fp"), radius, lanes))
    rooted = groups.join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = reliable_checkpoint(rooted)
    # a stored side lets Spark split the other one at a large component
    smallest = reliable_checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "fp")


def radius_of(similarity: float, lanes: int, deviations: float = 1.0) -> int:
    """Bits in which two texts with this Jaccard similarity of their shingle sets are expected to differ, and some deviations more."""
    angle = acos(2 * similarity / (1 + similarity)) / pi
    return round(64 * lanes * angle + deviations * sqrt(64 * lanes * angle * (1 - angle)))


def distinct_names(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted names of the distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    words = Words.of(Block.of([t.lower() for t in texts]), NOT_SPACE)
    names = words.names()
    grams, first = gram_names(names, shingle), words.first.tolist()
    return [np.unique(grams[a : b - shingle + 1] if b - a >= shingle else gram_names(names[a:b], b - a) if b > a else names[:0]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _set_key(names: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(names.tobytes())


def shingle_sets(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` of the distinct shingles, ``key`` (equal exactly for equal sets) and ``n`` (distinct shingles) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in all_pieces(batches):
            sets = distinct_names(text_bytes(piece.column("text")), shingle)
            columns = [
                piece.column("doc_id"),
                piece.column("text_hash"),
                pa.array([_majority(s, lanes) for s in sets], type=pa.binary()),
                pa.array([_set_key(s) for s in sets], type=pa.binary()),
                pa.array([len(s) for s in sets], type=pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "key", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp binary, key binary, n long")


def _different(piece: pa.RecordBatch, shingle: int) -> dict[bytes, np.ndarray]:
    """Different sets of shingles by their keys; texts without words are left out."""
    return {_set_key(s): s for s in distinct_names(text_bytes(piece.column("text")), shingle) if len(s)}


def common_shingles(docs: DataFrame, shingle: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Names of the most widespread shingles, sorted, and how widespread each is.

    Counted are the different sets that hold a shingle, where a flush has several of them.  What comes of this is only the
    order in which prefixes are taken, and any order is right: a shingle that is not known here makes larger blocks, no other links.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def heard(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
            names, count = np.unique(np.concatenate([*sets.values()]), return_counts=True)
            many = count > 1
            return pa.RecordBatch.from_arrays([pa.array(names[many].view(np.int64)), pa.array(count[many])], names=["name", "n"])

        held: dict[bytes, np.ndarray] = {}
        size = 0
        for piece in all_pieces(batches):
            held |= _different(piece, shingle)
            size += piece.nbytes
            if held and size >= FLUSH_BYTES:
                yield heard(held)
                held, size = {}, 0
        if held:
            yield heard(held)

    told = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "name long, n long")
    levels = reliable_checkpoint(told.groupBy("name").agg(F.floor(8 * F.log2(F.sum("n"))).cast("int").alias("level")))
    total, least = 0, None
    for r in levels.groupBy("level").agg(F.count(F.lit(1)).alias("names")).orderBy(F.desc("level")).collect():  # some hundred rows at most
        total += r["names"]
        if total > most:
            break
        least = r["level"]
    found = levels.where(F.lit(False) if least is None else F.col("level") >= least).toArrow()
    names = found.column("name").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], found.column("level").to_numpy()[order].astype(np.int16)


def prefix_marks(names: np.ndarray, size: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Marks the ``names`` (sets of ``size`` names each, sorted, one after another) that belong to the prefix of their set.

    A set of n names shares at least ``similarity`` * n of them with any set as similar as that.  So two such sets share one of
    the first n - ``similarity`` * n + 1 names of either, in any order that both have in common: here the unknown ones
    come first, then the known ones as widespread as they are.
    """
    table, level = common
    own = np.repeat(np.arange(len(size)), size)
    room = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
    at = lookup(names, table)
    rare = at < 0
    seen = np.append(0, np.cumsum(rare))
    end = np.cumsum(size)
    before = seen[end - size]
    marks = rare & (seen[:-1] - before[own] < room[own])
    left = room - (seen[end] - before)
    known = np.flatnonzero(~rare)
    known = known[np.lexsort((names[known], level[at[known]], own[known]))]
    of = own[known]
    marks[known[np.arange(len(of)) - np.searchsorted(of, of) < left[of]]] = True
    return marks


def prefix_blocks(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """``name``, ``chunk``, ``chunks``, ``ids``: the sets (first 64 bits of their keys) whose prefixes hold the same shingle.

    What travels are arrays of 32 bits of a name and the id of its set; only names that several sets have come back as rows.  The
    sets of a very frequent name are dealt to chunks, other ones for each name.
    """
    known = docs.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("ids", pa.binary())])
    answers = pa.schema([("name", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("ids", pa.list_(pa.int64()))])

    def prefixes(sets: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, sets.values()), dtype=np.int64, count=len(sets))
        names = np.concatenate([*sets.values()])
        marks = prefix_marks(names, size, similarity, known.value)
        return names[marks], np.repeat(joined((k[:8] for k in sets), ">i8").astype(np.int64), size)[marks]

    def dealt(names: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        bucket = ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, names, ids = bucket[order], names[order].astype(np.uint32), ids[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        spans = [*zip(cuts[:-1], cuts[1:], strict=True)]
        rows = {"bucket": [int(bucket[a]) for a, _ in spans], "names": [names[a:b].tobytes() for a, b in spans], "ids": [ids[a:b].tobytes() for a, b in spans]}
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        told: set[bytes] = set()
        size = 0
        for piece in all_pieces(batches):
            if sets := {k: s for k, s in _different(piece, shingle).items() if k not in told}:
                held.append(prefixes(sets))
                told |= sets.keys()
            size += piece.nbytes
            if held and size >= FLUSH_BYTES:
                yield dealt(*map(np.concatenate, zip(*held, strict=True)))
                held, told, size = [], set(), 0
        if held:
            yield dealt(*map(np.concatenate, zip(*held, strict=True)))

    def answer(table: pa.Table) -> pa.Table:
        names, ids = joined(table.column("names").to_pylist(), np.uint32), joined(table.column("ids").to_pylist(), np.int64)
        order = np.lexsort((ids, names))
        names, ids = names[order], ids[order]
        new = np.append(True, (names[1:] != names[:-1]) | (ids[1:] != ids[:-1]))  # exact copies come from several flushes
        names, ids = names[new].astype(np.int64) + (table.column("bucket")[0].as_py() << 32), ids[new]
        head = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        count = np.diff(np.append(head, len(names)))
        chunks = -(-count // BLOCK_SETS)
        entry = np.repeat(chunks, count)
        part = np.where(entry > 1, (mix(ids.view(np.uint64) ^ mix(names.view(np.uint64))) % entry.astype(np.uint64)).astype(np.int64), 0)
        kept = np.flatnonzero(np.repeat(count > 1, count))
        kept = kept[np.lexsort((part[kept], names[kept]))]
        names, ids, part, entry = names[kept], ids[kept], part[kept], entry[kept]
        head = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (part[1:] != part[:-1]))[: len(names)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(names)).astype(np.int32)), pa.array(ids))
        return pa.Table.from_arrays([pa.array(names[head]), pa.array(part[head].astype(np.int32)), pa.array(entry[head].astype(np.int32)), lists], schema=answers)

    notes = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, names binary, ids binary")
    return notes.groupBy("bucket").applyInArrow(answer, "name long, chunk int, chunks int, ids array<long>")


def near_forest(words: np.ndarray, size: np.ndarray, side: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the same sets as all pairs within ``radius`` bits, and of sizes that allow the similarity, do; of pairs
    whose ``side`` differs, or where none does of all pairs."""
    across = len(side) > 0 and bool((side != side[0]).any())
    label, out = np.arange(len(words)), []
    for i in range(len(words) - 1):
        if len(out) == len(words) - 1:  # all are connected
            break
        fits = label[i + 1 :] != label[i]
        fits &= (size[i + 1 :] >= size[i] * similarity - 1) & (size[i + 1 :] * similarity - 1 <= size[i])
        if across:
            fits &= side[i + 1 :] != side[i]
        other = np.flatnonzero(fits) + i + 1
        if len(other):
            for j in other[np.bitwise_count(words[other] ^ words[i]).sum(axis=1, dtype=np.int64) <= radius].tolist():
                x, y = label[i], label[j]
                if x != y:
                    out.append((i, j))
                    label[label == max(x, y)] = min(x, y)
    return out


def _compared(nodes: DataFrame, blocks: DataFrame, radius: int, similarity: float, lanes: int) -> DataFrame:
    """``a``, ``b``: links between keys of ``nodes`` (``id``, ``key``, ``fp``, ``n``) within each of the ``blocks`` (``ids``, of which the first ``left`` are compared with the others, if any)."""
    members = blocks.distinct().select(F.xxhash64("ids", "left").alias("block"), "left", F.posexplode("ids").alias("at", "id"))
    held = members.join(nodes, "id").groupBy("block").agg(F.collect_list(F.struct("key", "fp", "n", (F.col("at") < F.col("left")).alias("side"))).alias("sets"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                sets = batch.column("sets")[k].values
                keys, n, side = sets.field("key").to_pylist(), sets.field("n").to_numpy(), sets.field("side").to_numpy(zero_copy_only=False)
                for i, j in near_forest(_words(sets.field("fp").to_pylist(), lanes), n, side, radius, similarity):
                    a.append(keys[i])
                    b.append(keys[j])
            if a:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return held.select("sets").mapInArrow(compare, "a binary, b binary")


def candidate_links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, lanes: int) -> DataFrame:
    """``a``, ``b``: links between the keys of ``nodes`` (``key``, ``fp``, ``n`` of all sets of ``docs``) that connect all sets whose prefixes
    share a shingle, whose sizes allow the similarity and whose fingerprints are within the candidates' radius."""
    radius = radius_of(similarity, lanes, DEVIATIONS)
    own = nodes.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("id"), "key", "fp", "n")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = reliable_checkpoint(prefix_blocks(docs, shingle, similarity, common_shingles(docs, shingle), max(1, -(-total // BUCKET_SHINGLES))))
    within = _compared(own, blocks.select("ids", F.lit(0).alias("left")), radius, similarity, lanes)
    wide = blocks.where("chunks > 1")
    if wide.isEmpty():
        return within
    # chunks of one name are compared only if their sets are not connected yet; chunks of other names join those of near copies
    within = reliable_checkpoint(within)
    roots = own.join(components(within).withColumnRenamed("node", "key"), "key", "left").select("id", F.coalesce("root", "key").alias("root"))
    apart = wide.select("name", F.explode("ids").alias("id")).join(roots, "id").groupBy("name").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    wide = reliable_checkpoint(wide.join(apart.select("name"), "name"))
    left = wide.where("chunk + 1 < chunks").select("name", F.col("ids").alias("a"), F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("chunk"))
    pairs = left.join(wide.select("name", "chunk", "ids"), ["name", "chunk"]).select(F.concat("a", "ids").alias("ids"), F.size("a").alias("left"))
    return within.unionByName(_compared(own, pairs, radius, similarity, lanes))


def packed(names: np.ndarray) -> bytes:
    """Sorted lower ``NAME_BYTES`` bytes of different names, without repeats."""
    low = np.unique(names & np.uint64((1 << 8 * NAME_BYTES) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()


def unpacked(names: bytes) -> np.ndarray:
    short = np.frombuffer(names, dtype=np.uint8).reshape(-1, NAME_BYTES)
    out = np.zeros((len(short), 8), dtype=np.uint8)
    out[:, :NAME_BYTES] = short
    return out.view("<u8").ravel().astype(np.uint64)


def similar_forest(keys: list[bytes], names: list[bytes], first: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that connect the same sets as all pairs with a Jaccard similarity of ``similarity`` do, of pairs with one side among the ``first``.

    With ``first`` = all, every pair is compared; else those across the border.  Sets are sorted by size, so the partners of a
    set are one range of the other side.
    """
    sets = [unpacked(n) for n in names]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    across = first < len(sets)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, dtype=np.int64)
    begin = np.cumsum(size) - size
    right = np.arange(first, len(sets)) if across else np.arange(len(sets))
    right = right[size[right] > 0]
    right = right[np.argsort(size[right], kind="stable")]
    flat = np.concatenate([ids[begin[j] : begin[j] + size[j]] for j in right]) if len(right) else np.zeros(0, dtype=np.int64)
    sizes = size[right]
    edge = np.append(0, np.cumsum(sizes))
    label, links_ = np.arange(len(sets)), []
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    for i in range(first if across else len(sets)):
        n = int(size[i])
        # the smaller set must hold this part of the larger one; the slack is for rounding
        low, high = np.searchsorted(sizes, int(n * similarity) - 1), np.searchsorted(sizes, int(n / similarity) + 1, side="right")
        if not n or low >= high or (label[right[low:high]] == label[i]).all():
            continue
        own = ids[begin[i] : begin[i] + n]
        mark[own] = True
        common = np.add.reduceat(mark[flat[edge[low] : edge[high]]], edge[low:high] - edge[low], dtype=np.int64)
        mark[own] = False
        found = right[low:high][common >= similarity * (n + sizes[low:high] - common) - 1e-9]
        for j in found.tolist():
            x, y = label[i], label[j]
            if x != y:
                links_.append((keys[i], keys[j]))
                label[label == max(x, y)] = min(x, y)
    return links_


def similar_links(docs: DataFrame, rows: DataFrame, shingle: int, similarity: float, lanes: int) -> DataFrame:
    """``a``, ``b``: links between the keys of ``rows`` (``shingle_sets`` of ``docs``) that connect the same components as all pairs
    of sets with at least this Jaccard similarity do, up to pairs whose fingerprints are beyond the candidates' radius."""
    member = F.min(F.struct("doc_id", "text_hash")).alias("member")  # one row whose text stands for the set
    nodes = reliable_checkpoint(rows.groupBy("key", "fp", "n").agg(member))
    stars = components(candidate_links(docs, nodes, shingle, similarity, lanes))
    rooted = reliable_checkpoint(nodes.join(stars.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    sums = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("names")).where("sets > 1")
    chunks = F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("names") / CHUNK_NAMES)).cast("int")
    sums = reliable_checkpoint(sums.select("root", chunks.alias("chunks")))
    wanted = rooted.join(sums, "root").select("member", "key", "root", "chunks", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in all_pieces(batches):
            sets = [packed(s) for s in distinct_names(text_bytes(batch.column("text")), shingle)]
            kept = [batch.column(c) for c in ("key", "root", "chunks", "chunk")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, type=pa.binary())], names=["key", "root", "chunks", "chunk", "names"])

    texts = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).alias("member"), F.col("text").cast("string").alias("text"))
    sets = texts.join(wanted, "member").select("text", "key", "root", "chunks", "chunk").mapInArrow(read, "key binary, root binary, chunks int, chunk int, names binary")
    held = reliable_checkpoint(sets.groupBy("root", "chunks", "chunk").agg(F.collect_list(F.struct("key", "names")).alias("a")))
    left = held.where("chunks > 1").select("root", "a", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks"))).alias("chunk"))
    across = left.join(held.select("root", "chunk", F.col("a").alias("b")), ["root", "chunk"]).select("a", "b")
    kind = held.schema["a"].dataType
    pairs = held.select("a", F.lit(None).cast(kind).alias("b")).unionByName(across)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in range(2))
                both = a + (b or [])
                found = similar_forest([x["key"] for x in both], [x["names"] for x in both], len(a), similarity)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return pairs.mapInArrow(compare, "a binary, b binary")


def first_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each group of near copies: the one with the smallest ``doc_id`` (among
    rows with equal ids the one with the smallest hash of its text; of identical rows any one).

    Groups are connected by pairs whose sets of shingles have at least this Jaccard similarity; texts without words are one group.
    """
    rows = reliable_checkpoint(shingle_sets(docs, shingle, lanes))
    stars = components(similar_links(docs, rows, shingle, similarity, lanes))
    found = rows.join(stars.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = found.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("key"))
    # columns of the input are packed away, whatever their names
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn(
        "key", F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_hash"))
    )
    one = Window.partitionBy("key").orderBy("key")
    stays = keyed.join(kept.select("key"), "key", "left_semi").withColumn("copy", F.row_number().over(one)).where("copy = 1")
    return stays.select("row.*")
