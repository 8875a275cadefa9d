"""Substring dedup by recompression: repeated word windows found and verified through locally consistent symbols.

A document is a sequence of word names.  Recompression shortens it: first a run of more equal tokens than
a window holds is named by one window's worth of them (its further windows have the same content), then in each of two pair
rounds every symbol belongs to the left or the right half of the alphabet by a hash of its name, and a left symbol
followed by a right one becomes one symbol named after both.  Names are 64-bit hashes of what they stand for, so a symbol
has the same name in every task.  Whether two neighbours join depends on these two alone: a second-round border at word p
follows from words p-2 to p+1, and a symbol from its words and two on either side, its *frame*.  Second-round symbols
hold at most four words, so every 13-word window has one that begins at its third to eighth word, with its frame inside.

The *anchor* of a window is the widest of these symbols (the smallest name decides), named with its frame.  Equal windows
have equal anchors.  A Spark round deals the anchors to buckets and tells the parts which of them several documents hold: only
these reveal repeats.  A second round verifies them: windows with shared anchors are named by all their words (64 bits and the bucket
of a second hash) and dealt to buckets, where the smallest document of each window content is found and sent back.
Two scans of the text, one shuffle of it; nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_SPACE, Block, Words, covered, gram_names, lookup, mix, pieces, text_bytes, whole_windows
from .shared import joined, layout, shared_anchors, short_key, with_part

WINDOW = 13
FRAME = 2  # words on either side on which a second-round symbol depends
WIDEST = 4  # words of a second-round symbol, at most
FROM, TO = FRAME, WINDOW - FRAME - WIDEST  # words of the window at which its anchor may begin
SALTS = (0x51, 0xA7)  # one for each pair round
SEVERAL = np.uint32(1 << 31)  # mark of a window that several documents of a part have
NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def cap_runs(names: np.ndarray, text: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Marks the tokens that stay when every run of equal tokens in a text is cut to ``most``: no window content is lost."""
    if not len(names):
        return np.zeros(0, dtype=bool)
    fresh = np.append(True, (names[1:] != names[:-1]) | (text[1:] != text[:-1]))
    at = np.arange(len(names))
    return at - np.maximum.accumulate(np.where(fresh, at, 0)) < most


def pair_round(symbols: np.ndarray, text: np.ndarray, start: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join every left symbol with a right one that follows it in the same text."""
    if not len(symbols):
        return symbols, text, start
    left = (mix(symbols ^ np.uint64(salt)) & np.uint64(1)) == 0
    join = np.append(left[:-1] & ~left[1:] & (text[:-1] == text[1:]), False)
    named = np.where(join, mix(symbols * np.uint64(0x9E3779B97F4A7C15) + np.roll(symbols, -1) + np.uint64(salt)), symbols)
    head = np.append(True, ~join[:-1])
    return named[head], text[head], start[head]


def symbols(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the second-round symbols and the word at which each begins."""
    named, of, start = names, text, np.arange(len(names))
    for salt in SALTS:
        named, of, start = pair_round(named, of, start, salt)
    return named, start


def framed(names: np.ndarray, named: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of each symbol as an anchor: widest first, then by a name of the symbol and of its frame (beyond the block: its end)."""
    end = np.append(start[1:], len(names))
    width = np.minimum(end - start, WIDEST).astype(np.uint64)
    padded = np.concatenate((np.zeros(FRAME, dtype=np.uint64), names, np.zeros(FRAME, dtype=np.uint64)))
    name = named.copy()
    for k in range(FRAME):
        name = mix(mix(name + padded[start + k]) ^ padded[end + FRAME + k])
    return (name >> np.uint64(2)) | ((np.uint64(WIDEST) - width) << np.uint64(62))


def window_anchors(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Anchor of each window start (text borders ignored: callers drop windows that cross one)."""
    n = max(0, len(names) - WINDOW + 1)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    named, start = symbols(names, text)
    value = np.full(len(names), NO_KEY)
    value[start] = framed(names, named, start)
    out = value[FROM : FROM + n].copy()
    for j in range(FROM + 1, TO + 1):
        np.minimum(out, value[j : j + n], out=out)
    return mix(out)


def _first(text: np.ndarray, texts: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(texts + 1))


def _anchors(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words.of(Block.of(text_bytes(piece.column("text"))), NOT_SPACE)
    names = words.names()
    keep = cap_runs(names, words.text)
    names, text = names[keep], words.text[keep]
    anchor = window_anchors(names, text)
    known = piece.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(whole_windows(_first(text, piece.num_rows), text, WINDOW) & known[text[: len(anchor)]])
    anchor, of = anchor[ok], text[ok]
    fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])) if len(anchor) else np.zeros(0, dtype=bool)
    return anchor[fresh], of[fresh], of[fresh]


def removed_windows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` for every row of ``docs`` (columns ``doc_id``, ``text``).

    Nulls: a null text has no words; a row without ``doc_id`` is neither before nor after any other, so it keeps
    everything and removes nothing.  Rows with the same ``doc_id`` do not remove each other's words.  Other columns are ignored.
    """
    parts, buckets = layout(docs)
    rows = with_part(docs, parts)  # both joins below read this very frame, so its texts are shuffled once
    shared = shared_anchors(rows, _anchors, buckets)

    def ask(key, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = np.unique(joined(right.column("keys").to_pylist(), np.uint64))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(wanted):
            for piece in pieces(left):
                words = Words.of(Block.of(text_bytes(piece.column("text"))), NOT_SPACE)
                names = words.names()
                keep = cap_runs(names, words.text)
                text = words.text[keep]
                at = np.flatnonzero(whole_windows(_first(text, piece.num_rows), text, WINDOW))
                anchor = window_anchors(names[keep], text)[at]
                ids = piece.column("doc_id")
                at = at[(lookup(short_key(anchor, buckets), wanted) >= 0) & ids.is_valid().to_numpy()[text[at]]]
                doc = ids.fill_null(0).to_numpy()[text[at]]
                found.append((gram_names(words.names(1)[keep], WINDOW, 1)[at], gram_names(names[keep], WINDOW)[at], doc))
        columns: dict[str, list] = {"bucket": [], "part": [], "names": [], "at": [], "ids": []}
        if found:
            name, second, doc = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((doc, name))
            name, second, doc = name[order], second[order], doc[order]
            head = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, dtype=np.int64)
            last = np.append(head[1:], len(name)) - 1 if len(name) else head
            several = doc[head] != doc[last]
            name, second, doc = name[head], second[head], doc[head]
            bucket = (second % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            name, doc, several, bucket = name[order], doc[order], several[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                if b > a:
                    ids, at = np.unique(doc[a:b], return_inverse=True)
                    columns["bucket"].append(int(bucket[a]))
                    columns["part"].append(key[0].as_py())
                    columns["names"].append(name[a:b].tobytes())
                    columns["at"].append((at.astype(np.uint32) | np.where(several[a:b], SEVERAL, np.uint32(0))).tobytes())
                    columns["ids"].append(ids.tobytes())
        yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("names", pa.binary()), ("at", pa.binary()), ("ids", pa.binary())]))

    def ask_table(key, left, right):
        return pa.Table.from_batches(list(ask(key, left, right)))

    def smallest(table: pa.Table) -> pa.Table:
        asked = table.column("names").to_pylist()
        name = joined(asked, np.uint64)
        part = np.repeat(table.column("part").to_numpy(), [len(v) // 8 for v in asked])
        ats = [np.frombuffer(a, dtype=np.uint32) for a in table.column("at").to_pylist()]
        doc = np.concatenate([np.frombuffer(i, dtype=np.int64)[a & ~SEVERAL] for i, a in zip(table.column("ids").to_pylist(), ats, strict=True)])
        several = (np.concatenate(ats) & SEVERAL) > 0
        unique, inverse = np.unique(name, return_inverse=True)
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, doc)
        least = least[inverse]
        told = (least < doc) | several  # all others are first themselves
        name, part, least = name[told], part[told], least[told]
        order = np.argsort(part, kind="stable")
        name, part, least = name[order], part[order], least[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        spans = [(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True) if b > a]
        return pa.table(
            {"part": [int(part[a]) for a, _ in spans], "names": [name[a:b].tobytes() for a, b in spans], "least": [least[a:b].tobytes() for a, b in spans]},
            schema=pa.schema([("part", pa.int32()), ("names", pa.binary()), ("least", pa.binary())]),
        )

    def keep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        name = joined(right.column("names").to_pylist(), np.uint64)
        least = joined(right.column("least").to_pylist(), np.int64)
        order = np.lexsort((least, name))
        name, least = name[order], least[order]
        head = np.append(True, name[1:] != name[:-1]) if len(name) else np.zeros(0, dtype=bool)
        name, least = name[head], least[head]
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
        for piece in pieces(left):
            texts = text_bytes(piece.column("text"))
            words = Words.of(Block.of(texts), NOT_SPACE)
            at = np.flatnonzero(whole_windows(words.first, words.text, WINDOW))
            seen = lookup(gram_names(words.names(1), WINDOW, 1)[at], name) if len(name) else np.full(len(at), -1)
            at, seen = at[seen >= 0], seen[seen >= 0]
            ids = piece.column("doc_id")
            doc = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            drop = covered(at[least[seen] < doc[words.text[at]]], WINDOW, len(words.start))
            lost = np.add.reduceat(np.append(drop, False).astype(np.int64), np.minimum(words.first[:-1], len(drop))) if len(texts) else []
            count = np.diff(words.first)
            for i, text in enumerate(texts):
                tokens = text.split()
                n_lost = int(lost[i]) if count[i] else 0
                if n_lost:
                    mark = drop[words.first[i] : words.first[i + 1]]
                    tokens = [w for w, gone in zip(tokens, mark.tolist(), strict=True) if not gone]
                out["n_words"].append(int(count[i]))
                out["n_removed"].append(n_lost)
                out["kept_sha256"].append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            out["doc_id"].extend(ids.to_pylist())
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    asked = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(ask_table, "bucket int, part int, names binary, at binary, ids binary")
    told = asked.groupBy("bucket").applyInArrow(smallest, "part int, names binary, least binary")
    return rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(keep, OUT)
