"""Words and names of many texts at once, as numpy arrays.

Operators that cannot be expressed with Spark's functions work on blocks of a few MB of text inside a task.  A block
is one byte array; words are byte ranges in it, and a name is a 64-bit hash of a range, equal for equal content on
every executor, so no table of names has to be built or shipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20  # text per block; a longer single text is a block of its own

_GAMMA, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x2545F4914F6CDD1D | 2, 0xD6E8FEB86659FD93 | 2)  # odd, and one less is twice an odd number


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit changes about half of the output bits."""
    x = x + _GAMMA
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = tuple(mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (lane + 1))) for lane in range(2))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        base = _BASES[lane]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[lane] = (out[0], out[1])
    return have


def span_names(symbols: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of ranges of ``symbols``, whose own names stand in ``table``."""
    power, inverse = _powers(0, len(symbols) + 1)
    prefix = np.empty(len(symbols) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(table[symbols] * power[: len(symbols)], out=prefix[1:])
    return mix(((prefix[end] - prefix[start]) * inverse[start]) ^ ((end - start).astype(np.uint64) * _GAMMA))


NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Block:
    """Texts of a block joined by blanks, with the byte range of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        joined = b" ".join(texts) + b" "
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        end = np.cumsum(size + 1) - 1
        return cls(np.frombuffer(joined, dtype=np.uint8), end - size, end)

    def prefix(self, lane: int) -> np.ndarray:
        """Running sum from which the name of any byte range follows."""
        out = np.empty(len(self.data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(_BYTES[lane][self.data] * _powers(lane, len(self.data))[0][: len(self.data)], out=out[1:])
        return out


def range_names(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Names of byte ranges: equal exactly for equal content (up to hash collisions)."""
    inverse = _powers(lane, len(prefix))[1]
    raw = (prefix[end] - prefix[start]) * inverse[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * _GAMMA))


@dataclass
class Words:
    """Words of a block: byte ranges, the text each belongs to, and the first word of each text (with an end mark)."""

    block: Block
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, block: Block, is_word: np.ndarray) -> Words:
        inside = is_word[block.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate((np.zeros(1, dtype=np.int64), edges))
        start, end = edges[0::2], edges[1::2]
        first = np.append(np.searchsorted(start, block.start), len(start))
        text = np.repeat(np.arange(len(block.start)), np.diff(first))
        return cls(block, start, end, text, first)

    def names(self, lane: int = 0) -> np.ndarray:
        return range_names(self.block.prefix(lane), self.start, self.end, lane)


def gram_names(names: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Names of all runs of ``width`` neighbours, text borders ignored."""
    n = max(0, len(names) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    base = np.uint64(_BASES[lane])
    for j in range(width):
        out *= base
        out += names[j : j + n]
    return mix(out)


def whole_windows(first: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Marks the window starts whose ``width`` neighbours lie in one text (length: number of windows)."""
    n = max(0, len(text) - width + 1)
    return np.arange(n) + width <= first[text[:n] + 1] if n else np.zeros(0, dtype=bool)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks of ``n`` positions that lie in one of the windows beginning at ``starts``."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator:
    """Slices of an Arrow batch or table with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    block = total // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def all_pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, column, limit)


def lookup(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table without repeats, or -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
