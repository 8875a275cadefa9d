"""Byte-exact removal of repeated 400-byte strings with suffix arrays built by linear grouping.

A suffix array of the whole table would be one task.  Instead every 400-byte window is owned by one *anchor* inside it:
the leftmost 64-byte string with the smallest name.  Equal windows have equal anchors at equal places, so anchors that occur once cannot lie
in a repeated window.  Relative to its anchor, a window belongs to a *slot* of 64 neighbouring window starts; all windows of a slot contain the
same 337 bytes, the slot's *core*, and differ in up to 63 bytes on either side.  Spark brings slots with equal cores
together.  There the core is one symbol, a window is 64 symbols, and a window is repeated exactly when the suffix that begins with it
agrees with a neighbour in the suffix array in 64 symbols.

The suffix array is built by grouping: suffixes are grouped by their longest Lyndon prefix, the groups being processed
in descending order while pointers to the previous smaller suffix extend the groups to the left; then each group's
order follows from the order of what comes after its Lyndon prefix.  No renaming rounds, linear number of steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, lookup, mix, pieces, range_names, text_bytes
from .shared import joined, layout, shared_anchors, short_key, with_part

WINDOW = 400
ANCHOR = 64
SLOT = 64
CORE = WINDOW - SLOT + 1
REACH = WINDOW - ANCHOR  # last place in a window at which its anchor may begin
GROUPS_AT_ONCE = 1 << 18  # symbols in one suffix array, unless one core has more
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ASK = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("core", pa.binary()), ("core2", pa.binary()), ("slot", pa.binary()), ("sides", pa.binary()), ("text", pa.binary())])
TOLD = pa.schema([("part", pa.int32()), ("slot", pa.binary()), ("marks", pa.binary())])


def lyndon_groups(text: list[int]) -> tuple[list[list[int]], list[int]]:
    """Suffix starts grouped by longest Lyndon prefix, groups ascending, and the length of each group's prefix."""
    symbols = sorted(set(text))
    of = {c: k for k, c in enumerate(symbols)}
    group = [of[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(symbols)
    below = list(range(-1, len(symbols) - 1))  # neighbours in the order of the groups
    above = list(range(1, len(symbols) + 1))
    previous = list(range(-1, len(text) - 1))  # leads to the nearest position on the left whose group is still lower
    done = bytearray(len(text))
    order = []
    now = len(symbols) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        if not own:
            now = below[now]
            continue
        members[now] = own
        order.append(now)
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = previous[i]
            if j >= 0 and done[j]:
                way = [i]
                while j >= 0 and done[j]:
                    way.append(j)
                    j = previous[j]
                for k in way:
                    previous[k] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, t in times.items():
                moved.setdefault((t, group[j]), []).append(j)
            for t, g in sorted(moved, reverse=True):  # more repetitions: the higher group
                fresh = len(members)
                members.append(moved[t, g])
                length.append(length[g] + t * length[now])
                for j in moved[t, g]:
                    group[j] = fresh
                top = above[g]
                below.append(g)
                above.append(top)
                below[top] = above[g] = fresh
        now = below[now]
    order.reverse()
    return [members[g] for g in order], [length[g] for g in order]


def suffix_array(text: list[int]) -> np.ndarray:
    """Suffix starts in ascending order (a suffix that is a prefix of another comes first)."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    groups, lengths = lyndon_groups(text)
    size = np.fromiter(map(len, groups), dtype=np.int64, count=len(groups))
    where = np.fromiter((i for g in groups for i in g), dtype=np.int64, count=n)
    after = np.empty(n, dtype=np.int64)  # the suffix that follows the Lyndon prefix of each: smaller than it
    after[where] = where + np.repeat(np.array(lengths, dtype=np.int64), size)
    rank = np.empty(n, dtype=np.int64)
    rank[where] = np.repeat(np.arange(len(groups)), size)
    by = np.argsort(after, kind="stable")
    begin = np.searchsorted(after[by], np.arange(n + 2)).tolist()
    child, slot, head = by.tolist(), rank.tolist(), (np.cumsum(size) - size).tolist()
    out = [0] * n
    for i in child[begin[n] :]:
        out[head[slot[i]]] = i
        head[slot[i]] += 1
    for r in range(n):
        s = out[r]
        for k in range(begin[s], begin[s + 1]):
            i = child[k]
            g = slot[i]
            out[head[g]] = i
            head[g] += 1
    return np.array(out, dtype=np.int64)


def repeated_suffixes(text: np.ndarray, need: int) -> np.ndarray:
    """Marks the positions whose next ``need`` symbols also begin somewhere else in ``text``."""
    order = suffix_array(text.tolist())
    padded = np.append(text, np.full(need, -1))
    a, b = order[:-1], order[1:]
    open_ = np.flatnonzero((a + need <= len(text)) & (b + need <= len(text)))
    for k in range(need):
        open_ = open_[padded[a[open_] + k] == padded[b[open_] + k]]
    out = np.zeros(len(text), dtype=bool)
    out[a[open_]] = out[b[open_]] = True
    return out


def _sliding(values: np.ndarray, width: int, extreme: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.uint64(fill), dtype=np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    ahead = extreme.accumulate(grid, axis=1).ravel()
    back = extreme.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return extreme(back[:n], ahead[width - 1 : width - 1 + n])


class Slots:
    """Anchors of a block of texts, the windows each owns, and the slots of these windows."""

    def __init__(self, texts: list[bytes]):
        self.block = block = Block.of(texts)
        self.prefix = block.prefix(0)
        n = len(block.data)
        self.anchor = self.name = self.low = self.high = self.text = np.zeros(0, dtype=np.int64)
        if n < WINDOW:
            self.name = self.name.astype(np.uint64)
            return
        at = np.arange(n - ANCHOR + 1)
        names = range_names(self.prefix, at, at + ANCHOR, 0) >> np.uint64(1)
        least = _sliding(names, REACH + 1, np.minimum, (1 << 64) - 1)
        chosen = np.concatenate((np.zeros(REACH, dtype=np.uint64), least, np.zeros(REACH, dtype=np.uint64)))
        anchor = np.flatnonzero(_sliding(chosen, REACH + 1, np.maximum, 0)[: len(names)] == names)
        name = names[anchor]
        text = np.searchsorted(block.end, anchor)
        low = np.maximum(anchor - REACH, block.start[text])
        high = np.minimum(anchor, block.end[text] - WINDOW)
        m = len(anchor)
        for side in (-1, 1):  # the leftmost of the smallest owns a window
            near, k = np.arange(m), 1
            while len(near):
                near = near[(near + side * k >= 0) & (near + side * k < m)]
                other = near + side * k
                close = np.abs(anchor[other] - anchor[near]) <= REACH
                near, other = near[close], other[close]
                if side < 0:
                    stop = name[other] <= name[near]
                    low[near[stop]] = np.maximum(low[near[stop]], anchor[other[stop]] + 1)
                else:
                    stop = name[other] < name[near]
                    high[near[stop]] = np.minimum(high[near[stop]], anchor[other[stop]] - REACH - 1)
                near = near[~stop]
                k += 1
        own = low <= high
        self.anchor, self.name, self.text, self.low, self.high = anchor[own], name[own], text[own], low[own], high[own]

    def slots(self, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window start of each slot (may lie before its text) and the text, without repeats."""
        anchor, low, high, text = self.anchor, self.low, self.high, self.text
        if use is not None:
            anchor, low, high, text = anchor[use], low[use], high[use], text[use]
        a, b = (low - anchor + REACH) // SLOT, (high - anchor + REACH) // SLOT
        many = b - a + 1
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = np.repeat(anchor - REACH + a * SLOT, many) + step * SLOT
        first, at = np.unique(first, return_index=True)
        return first, np.repeat(text, many)[at]

    def sides(self, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the bytes that the slot's windows can use within the text."""
        return np.maximum(first, self.block.start[text]), np.minimum(first + WINDOW + SLOT - 1, self.block.end[text])

    def slot_names(self, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Name of each core and of each slot's content (core and both sides)."""
        begin, end = self.sides(first, text)
        left, right = first + SLOT - 1, first + WINDOW
        core = range_names(self.prefix, left, right, 0)
        before, behind = range_names(self.prefix, begin, left, 0), range_names(self.prefix, right, end, 0)
        return core, mix(mix(core ^ (before << np.uint64(1))) + behind)


def _slot_marks(core: np.ndarray, slot: np.ndarray, several: np.ndarray, left: np.ndarray, right: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each distinct slot content, 64 bits: the windows that occur elsewhere.  Rows must be ordered by ``core``."""
    marks = np.zeros(len(slot), dtype=np.uint64)
    shift = np.arange(SLOT)
    fits = (shift[None, :] >= (SLOT - 1 - left)[:, None]) & (shift[None, :] <= right[:, None])
    bit = np.uint64(1) << shift.astype(np.uint64)
    marks[several] = (fits[several] * bit).sum(axis=1, dtype=np.uint64)
    head = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
    size = np.diff(np.append(head, len(core)))
    compare = np.flatnonzero(np.repeat(size > 1, size))
    place = 0
    while place < len(compare):
        stop, symbols = place, 0
        while stop < len(compare) and (symbols < GROUPS_AT_ONCE or core[compare[stop]] == core[compare[stop - 1]]):
            symbols += left[compare[stop]] + right[compare[stop]] + 2
            stop += 1
        rows = compare[place:stop]
        of_core = np.cumsum(np.append(0, core[rows][1:] != core[rows][:-1]))
        sizes = left[rows] + right[rows] + 2
        begin = np.cumsum(sizes) - sizes
        run = np.empty(int(sizes.sum()), dtype=np.int64)
        stops = len(rows)  # smallest symbols: one end mark for each row; then bytes; then cores
        at = np.arange(len(run)) - np.repeat(begin, sizes)
        l_of = np.repeat(left[rows], sizes)
        is_core, is_end = at == l_of, at == np.repeat(sizes - 1, sizes)
        run[is_core] = stops + 256 + of_core
        run[is_end] = np.arange(stops)
        run[~(is_core | is_end)] = np.frombuffer(b"".join([texts[i] for i in rows.tolist()]), dtype=np.uint8).astype(np.int64) + stops
        found = np.flatnonzero(repeated_suffixes(run, SLOT))
        row = np.searchsorted(begin, found, side="right") - 1
        offset = found - begin[row] + (SLOT - 1 - left[rows][row])
        ok = offset < SLOT
        np.bitwise_or.at(marks, rows[row[ok]], np.uint64(1) << offset[ok].astype(np.uint64))
        place = stop
    return marks


def removed_strings(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` for every row of ``docs``.

    Every byte that lies in a 400-byte string which begins anywhere else too goes; strings never cross documents.  A null text
    is empty; texts under 400 bytes stay; repeated rows are copies of each other; ``doc_id`` may be null and is only passed on.
    """
    parts, buckets = layout(docs)
    rows = with_part(docs, parts)

    def anchors(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = Slots(text_bytes(piece.column("text")))
        return s.name, s.anchor, s.text

    shared = shared_anchors(rows, anchors, buckets)

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(joined(right.column("keys").to_pylist(), np.uint64))
        found: list[tuple] = []
        if len(wanted):
            for piece in pieces(left):
                s = Slots(text_bytes(piece.column("text")))
                first, text = s.slots(lookup(short_key(s.name, buckets), wanted) >= 0)
                if not len(first):
                    continue
                core, slot = s.slot_names(first, text)
                core2 = range_names(s.block.prefix(1), first + SLOT - 1, first + WINDOW, 1)
                begin, end = s.sides(first, text)
                slot, at, count = np.unique(slot, return_index=True, return_counts=True)
                raw = s.block.data.tobytes()
                first, begin, end = first[at], begin[at], end[at]
                side = [raw[a : f + SLOT - 1] + raw[f + WINDOW : b] for a, f, b in zip(begin.tolist(), first.tolist(), end.tolist(), strict=True)]
                found.append((slot, core[at], core2[at], first + SLOT - 1 - begin, end - first - WINDOW, count > 1, side))
        columns: dict[str, list] = {name: [] for name in ASK.names}
        if found:
            slot, core, core2, l, r, several = (np.concatenate([f[k] for f in found]) for k in range(6))
            side = [x for f in found for x in f[6]]
            unique, at, count = np.unique(slot, return_index=True, return_counts=True)
            several = (count > 1) | (np.bincount(np.searchsorted(unique, slot), weights=several) > 0)
            core, core2, l, r = core[at], core2[at], l[at], r[at]
            bucket = (core2 % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cuts):
                columns["bucket"].append(int(bucket[part[0]]))
                columns["part"].append(key[0].as_py())
                columns["core"].append(core[part].tobytes())
                columns["core2"].append(core2[part].tobytes())
                columns["slot"].append(unique[part].tobytes())
                columns["sides"].append(np.stack((l[part], r[part], several[part])).astype(np.uint8).tobytes())
                columns["text"].append(b"".join([side[at[i]] for i in part.tolist()]))
        return pa.table(columns, schema=ASK)

    def mark(table: pa.Table) -> pa.Table:
        core, core2, slot = (joined(table.column(c).to_pylist(), np.uint64) for c in ("core", "core2", "slot"))
        sides = np.concatenate([np.frombuffer(v, dtype=np.uint8).reshape(3, -1) for v in table.column("sides").to_pylist()], axis=1).astype(np.int64)
        part = np.repeat(table.column("part").to_numpy(), [len(v) // 8 for v in table.column("slot").to_pylist()])
        text = b"".join(table.column("text").to_pylist())
        cut = np.append(0, np.cumsum(sides[0] + sides[1]))
        unique, at, inverse, count = np.unique(slot, return_index=True, return_inverse=True, return_counts=True)
        several = (count > 1) | (np.bincount(inverse, weights=sides[2]) > 0)
        order = np.lexsort((core2[at], core[at]))
        keep = at[order]
        group = np.cumsum(np.append(0, (core[keep][1:] != core[keep][:-1]) | (core2[keep][1:] != core2[keep][:-1])))
        marks = np.empty(len(unique), dtype=np.uint64)
        marks[order] = _slot_marks(group, unique[order], several[order], sides[0][keep], sides[1][keep], [text[cut[i] : cut[i + 1]] for i in keep.tolist()])
        got = marks[inverse]
        told = np.flatnonzero(got)
        told = told[np.argsort(part[told], kind="stable")]
        cuts = np.flatnonzero(np.diff(part[told])) + 1
        runs = [r for r in np.split(told, cuts) if len(r)]
        return pa.table({"part": [int(part[r[0]]) for r in runs], "slot": [slot[r].tobytes() for r in runs], "marks": [got[r].tobytes() for r in runs]}, schema=TOLD)

    def keep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        slots, marks = joined(right.column("slot").to_pylist(), np.uint64), joined(right.column("marks").to_pylist(), np.uint64)
        slots, at = np.unique(slots, return_index=True)
        marks = marks[at]
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for piece in pieces(left):
            texts = text_bytes(piece.column("text"))
            gone: dict[int, list[tuple[int, int]]] = {}
            if len(slots):
                s = Slots(texts)
                first, text = s.slots()
                if len(first):
                    _, name = s.slot_names(first, text)
                    seen = lookup(name, slots)
                    hit = np.flatnonzero(seen >= 0)
                    bits = np.unpackbits(marks[seen[hit]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                    row, offset = np.nonzero(bits)
                    start = np.unique(first[hit][row] + offset)
                    if len(start):
                        fresh = np.append(True, (np.diff(start) > WINDOW) | (np.diff(np.searchsorted(s.block.end, start)) > 0))
                        a = np.flatnonzero(fresh)
                        b = np.append(a[1:], len(start)) - 1
                        of = np.searchsorted(s.block.end, start[a])
                        for t, x, y in zip(of.tolist(), (start[a] - s.block.start[of]).tolist(), (start[b] + WINDOW - s.block.start[of]).tolist(), strict=True):
                            gone.setdefault(t, []).append((x, y))
            for i, text in enumerate(texts):
                spans = gone.get(i, [])
                kept, place = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(text[place:x])
                    place = y
                kept.update(text[place:])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(y - x for x, y in spans))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(kept.hexdigest())
            out["doc_id"].extend(piece.column("doc_id").to_pylist())
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    asked = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(ask, "bucket int, part int, core binary, core2 binary, slot binary, sides binary, text binary")
    told = asked.groupBy("bucket").applyInArrow(mark, "part int, slot binary, marks binary")
    return rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(keep, OUT)
