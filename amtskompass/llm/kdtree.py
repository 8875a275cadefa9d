"""Exact search for the k vectors with the largest inner products: a KD-tree for each shard of the table.

Vectors are dealt to shards of bounded size.  A task cuts its shard at medians along the widest side of the box until
leaves are small, keeps the tight bounding box of every node, and stores the tree as one row of the index.  Queries come
in blocks of bounded size; a block is sent to all shards.  For a box and a query the largest possible inner product
follows from the box's corners, so a query always opens its most promising node next and stops when none can reach its
kth score.  That score travels: a block first searches one shard, and what it finds there bounds the search in all
others; a task passes it on from shard to shard.

Scores are exact: whole numbers are multiplied as doubles while every sum stays below 2**53, else as 64-bit integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .inverted import shared_folder
from .vectors import matrix, usable

SHARD_ROWS = 8192
LEAF_ROWS = 128
QUERY_BLOCK = 16384  # queries that are sent to the shards at once
GROUP = 512  # queries that walk a tree together
INDEX = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("cuts", pa.binary())])
FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
LEAST = np.iinfo(np.int64).min


def cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and borders of the nodes of a tree; node ``v`` has the children ``2v + 1`` and ``2v + 2``.

    Every node is cut at the median of the side on which its box is longest; all leaves lie on one level.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF_ROWS))))
    order = np.arange(len(x))
    cuts = np.zeros((2 ** (depth + 1) - 1, 2), dtype=np.int64)
    cuts[0] = 0, len(x)
    for v in range(2**depth - 1):
        a, b = cuts[v]
        m = (a + b) // 2
        if b - a > 1:
            rows = x[order[a:b]]
            side = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if rows.shape[1] else 0
            if rows.shape[1]:
                order[a:b] = order[a:b][np.argpartition(rows[:, side], m - a)]
        cuts[2 * v + 1], cuts[2 * v + 2] = (a, m), (m, b)
    return order, cuts


def boxes(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tight lower and upper corners of all nodes; those of an empty node do not matter."""
    low, high = (np.zeros((len(cuts), x.shape[1]), dtype=x.dtype) for _ in range(2))
    for v, (a, b) in enumerate(cuts.tolist()):
        if b > a:
            low[v], high[v] = x[a:b].min(axis=0), x[a:b].max(axis=0)
    return low, high


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``k`` of each row by falling score, ties by rising id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)


class Search:
    """Best scores of a block of queries so far; ``floor`` holds for each query a score that its kth best will reach."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.queries, self.k = own, queries, k
        self.scores = np.full((len(own), k), LEAST + 1)
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)
        self.floor = floor.copy()

    def shard(self, ids: np.ndarray, x: np.ndarray, cuts: np.ndarray) -> None:
        width = max(x.shape[1], self.queries.shape[1])
        x, queries = _widened(x, width), _widened(self.queries, width)
        most = int(np.abs(x).max(initial=0)), int(np.abs(queries).max(initial=0))
        kind = np.float64 if width * most[0] * most[1] < 1 << 53 else np.int64
        x = x.astype(kind)
        low, high = boxes(x, cuts)
        for a in range(0, len(queries), GROUP):
            self._walk(np.arange(a, min(a + GROUP, len(queries))), queries[a : a + GROUP].astype(kind), ids, x, cuts, low, high)

    def _walk(self, at: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, cuts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Every query opens its best node until no open one can reach its floor; queries at one node go together."""
        closed = -np.inf if q.dtype == np.float64 else LEAST
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        open_ = np.full((len(q), len(cuts)), closed, dtype=q.dtype)
        open_[:, 0] = plus @ high[0] + minus @ low[0]
        live = np.arange(len(q))
        while True:
            node = open_[live].argmax(axis=1)
            go = (open_[live, node] != closed) & (open_[live, node] >= self.floor[at[live]])
            live, node = live[go], node[go]
            if not len(live):
                break
            open_[live, node] = closed
            by = np.argsort(node, kind="stable")
            starts = np.flatnonzero(np.diff(node[by], prepend=-1))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
                v, rows = int(node[by[i]]), live[by[i:j]]
                if 2 * v + 2 < len(cuts):
                    for child in (2 * v + 1, 2 * v + 2):
                        if cuts[child, 1] > cuts[child, 0]:
                            open_[rows, child] = plus[rows] @ high[child] + minus[rows] @ low[child]
                else:
                    a, b = cuts[v]
                    self._leaf(at[rows], (q[rows] @ x[a:b].T).astype(np.int64), ids[a:b])

    def _leaf(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        own = ids[None, :] == self.own[at][:, None]
        scores = np.where(own, LEAST + 1, scores)
        hit = (scores >= self.floor[at][:, None]).any(axis=1) & ~own.all(axis=1)
        if not hit.any():
            return
        at, scores, own = at[hit], scores[hit], own[hit]
        named = np.where(own, np.iinfo(np.int64).max, ids[None, :])
        self.scores[at], self.ids[at] = _best(np.concatenate((self.scores[at], scores), axis=1), np.concatenate((self.ids[at], named), axis=1), self.k)
        self.floor[at] = np.maximum(self.floor[at], self.scores[at, -1])

    def found(self, numbers: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(self.ids[row, place]), pa.array(self.scores[row, place])], schema=FOUND)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of what a task gets, one for every ``SHARD_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def tree() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        column = table.column("x").combine_chunks()
        width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
        x, ids = matrix(column, width), table.column("id").to_numpy()
        order, cuts = cut(x)
        row = [[len(ids)], [ids[order].tobytes()], [x[order].tobytes()], [cuts.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, INDEX, strict=True)], schema=INDEX)

    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, SHARD_ROWS - rows), batch.slice(SHARD_ROWS - rows)
            held.append(part)
            rows += part.num_rows
            if rows == SHARD_ROWS:
                yield tree()
                held, rows = [], 0
    if held:
        yield tree()


def build_index(vectors: DataFrame) -> DataFrame:
    """Stored trees over ``id, x``, one row for each shard: its number of rows, ids, components and borders of the nodes."""
    rows = vectors.count()
    path = f"{shared_folder(vectors.sparkSession)}/kdtrees-{uuid.uuid4().hex}"
    dealt = vectors.repartition(max(1, -(-rows * 8 // (SHARD_ROWS * 7))))  # room for an uneven deal
    dealt.mapInArrow(_build, "shard long, ids binary, x binary, cuts binary").write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _search(index: DataFrame, own: np.ndarray, queries: np.ndarray, numbers: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((own, queries, numbers, floor))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries, numbers, floor = sent.value
        state = Search(own, queries, floor, k)
        for batch in batches:
            for n, ids, x, cuts in zip(*[batch.column(c).to_pylist() for c in ("shard", "ids", "x", "cuts")], strict=True):
                state.shard(np.frombuffer(ids, np.int64), np.frombuffer(x, np.int64).reshape(n, -1), np.frombuffer(cuts, np.int64).reshape(-1, 2))
        yield state.found(numbers)

    return index.mapInArrow(run, "query long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)


def top_k(rows: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every`` the ``k`` best other rows.

    All rows but those with the query's own id are candidates; a candidate row that is repeated counts as often as it
    stands, and ties go to the smaller id.  Rows without an id, or whose vector is null or holds a null or non-finite
    component, take no part.  Of repeated rows with a query's id each different vector is a query of its own.  A vector that
    is shorter than another is continued by zeros.  Empty tables give no rows.

    The candidates are written once as trees; each block of queries is one job over the stored index.
    """
    vectors = usable(rows, key, vector).where("id is not null")
    index = build_index(vectors)
    spark = rows.sparkSession
    asked = vectors.where(F.col("id") % every == 0).distinct()
    path = f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"
    asked.withColumn("query", F.monotonically_increasing_id()).write.parquet(path)
    asked = spark.read.parquet(path)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = None
    for b in range(blocks):
        table = asked.where(block == b).select("query", "id", "x").toArrow()  # a block: its size is bounded
        if not table.num_rows:
            continue
        column = table.column("x").combine_chunks()
        queries = matrix(column, int(np.diff(column.offsets.to_numpy()).max(initial=0)))
        own, numbers = table.column("id").to_numpy(), table.column("query").to_numpy()
        floor = np.full(len(own), LEAST + 1)
        ahead = _search(index.limit(1).coalesce(1), own, queries, numbers, floor, k).toArrow()
        floor = _kth(ahead, numbers, k)
        part = _search(index, own, queries, numbers, floor, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = asked.select("query", F.col("id").alias("query_id"))
    return _first(found, k).join(names, "query").select("query_id", "rank", "vec_id", "score")


def _kth(found: pa.Table, numbers: np.ndarray, k: int) -> np.ndarray:
    """The kth score of each query, or the least number where there are fewer."""
    floor = np.full(len(numbers), LEAST + 1)
    query, score = found.column("query").to_numpy(), found.column("score").to_numpy()
    place = np.argsort(numbers, kind="stable")
    at = place[np.searchsorted(numbers[place], query)]
    order = np.lexsort((-score, at))
    at, score = at[order], score[order]
    head = np.flatnonzero(np.diff(at, prepend=-1))
    size = np.diff(np.append(head, len(at)))
    full = size >= k
    floor[at[head[full]]] = score[head[full] + k - 1]
    return floor
