"""Cost-balanced packing of tokenised documents into sequences of fixed length.

The attention cost of a sequence is estimated as the sum over its documents of ``linear * n + quadratic * n ** 2``.  In
each flush (about 16 MB of text of one task) documents go, longest first, to the sequence of lowest cost that still has room for
them; when none has, the sequence of lowest cost with any room is filled and the rest of the document goes on.  The number of sequences is
the least that holds all tokens, so a flush of some 6000 sequences pads less than one of them.  Whole sequences of a long document need no placing.
Nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import all_pieces, mix, span_names
from .shared import FLUSH_BYTES

LENGTH = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 512
CACHE_WORDS = 600_000  # distinct pre-tokens whose ids a worker remembers
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Texts of these characters alone are split here (letters, digits and blanks of the Latin blocks are beyond doubt);
# all others are left to the tokenizer as a whole.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_SPECIAL = "<|"
_OTHER, _LETTER, _DIGIT, _BLANK = range(4)
_CLASS = np.zeros(0x250, dtype=np.int8)
for _kind, _members in ((_LETTER, "A-Za-zªµºÀ-ÖØ-öø-ɏ"), (_DIGIT, "0-9²³¹¼-¾"), (_BLANK, "\t\n\r ")):
    _CLASS[[ord(c) for c in re.findall(f"[{_members}]", "".join(map(chr, range(0x250))))]] = _kind
_NAMES = mix(np.arange(0x250, dtype=np.uint64) + np.uint64(77))
_QUOTE, _SPACE = ord("'"), ord(" ")


def pre_tokens(codes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a text given as code points: letters, digits or other signs, each with one space before
    it, the endings 's 't 're 've 'm 'll 'd, and blanks (the last one before a word apart)."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _CLASS[codes]
    fresh = np.empty(n, dtype=bool)  # begins a run of one kind
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    blank = kind == _BLANK
    start = fresh.copy()
    into = fresh[1:] & blank[:-1]  # a run of blanks ends before this place
    start[:-1] |= into  # its last blank stands apart ...
    start[1:] &= ~(into & (codes[:-1] == _SPACE))  # ... and a space goes with what follows
    quote = np.flatnonzero(codes == _QUOTE)
    quote = quote[start[quote] & (quote < n - 1)]
    if len(quote):
        after = np.append(codes, [0, 0])
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long_] + 1] = False
        end = np.concatenate((quote[short] + 2, quote[long_] + 3))
        start[end[end < n]] = True
    return np.flatnonzero(start)


def _ranked(tokenizer):
    """The same vocabulary for the faster library, where every merge has the rank of its id; else None."""
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the vocabulary
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Token ids of texts, equal to the tokenizer's own; ids of each distinct pre-token are looked up once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = _ranked(self.tokenizer)
        self.newline = self.encode("\n")
        self.clear()

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.pool = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def learn(self, names: list[int], words: list[str]) -> None:
        """Ids of new pre-tokens: those that are not blanks go through the tokenizer together, one in each line."""
        blank = [w[0] in "\t\n\r" or w.isspace() for w in words]
        text = "\n".join(w for w, b in zip(words, blank, strict=True) if not b)
        together = np.array(self.fast.encode_ordinary(text) if self.fast else self.encode(text), dtype=np.uint32)
        ends = np.flatnonzero(together == self.newline[0])
        sizes = [np.diff(np.append(np.append(-1, ends), len(together))) - 1]
        pools = [np.delete(together, ends)]
        order = [n for n, b in zip(names, blank, strict=True) if not b]
        if not order:
            sizes = []
        for name, word, b in zip(names, words, blank, strict=True):
            if b:
                order.append(name)
                pools.append(np.array(self.encode(word), dtype=np.uint32))
                sizes.append(np.array([len(pools[-1])]))
        self.known.update(zip(order, range(len(self.begin) - 1, len(self.begin) - 1 + len(order)), strict=True))
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes)))
        self.pool = np.concatenate((self.pool, *pools))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that can be split here, all as one array of code points with a line end after each."""
        whole = "\n".join(texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        bounds = np.append(0, np.cumsum(size + 1))
        starts = [pre_tokens(codes[a : b - 1]) + a for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        count = [len(s) for s in starts]
        start = np.concatenate(starts)
        end = np.append(start[1:], len(codes))
        last = np.cumsum(count) - 1
        end[last[np.array(count) > 0]] = bounds[1:][np.array(count) > 0] - 1
        names, first, at = np.unique(span_names(codes, _NAMES, start, end), return_index=True, return_inverse=True)
        index = [self.known.get(name, -1) for name in names.tolist()]
        new = [k for k, i in enumerate(index) if i < 0]
        if new:
            self.learn(names[new].tolist(), [whole[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            index = [self.known[name] for name in names.tolist()]
        word = np.array(index, dtype=np.int64)[at]
        many = self.begin[word + 1] - self.begin[word]
        upto = np.cumsum(many)
        ids = self.pool[np.repeat(self.begin[word] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.append(0, upto)[np.append(0, np.cumsum(count))]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, followed by id 0."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t) and _SPECIAL not in t]
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        for k, ids in zip(plain, self._plain([texts[k] for k in plain]) if plain else [], strict=True):
            out[k] = ids
        for k in set(range(len(texts))) - set(plain):
            out[k] = np.array(self.encode(texts[k]), dtype=np.uint32)
        return [np.append(ids, np.uint32(0)) for ids in out]


def place(sizes: list[int], length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, sequence, offset) with sizes below ``length`` placed in the fewest sequences; each
    piece runs to the next start of its document, or to its end."""
    total = sum(sizes)
    if not total:
        return []
    room = [length] * (-(-total // length))
    cheapest = [(0.0, s) for s in range(len(room))]  # heap of sequences with room by cost
    out = []
    waiting = [(-n, d, 0) for d, n in enumerate(sizes) if n]
    heapq.heapify(waiting)
    while waiting:
        negative, d, start = heapq.heappop(waiting)
        n, aside, cost, s = -negative, [], 0.0, -1
        while cheapest:
            cost, s = heapq.heappop(cheapest)
            if room[s] >= n:
                break
            aside.append((cost, s))
        else:  # no sequence has room for all of it: cut
            cost, s = aside.pop(0)
            heapq.heappush(waiting, (room[s] - n, d, start + room[s]))
            n = room[s]
        out.append((d, start, s, length - room[s]))
        room[s] -= n
        for entry in aside:
            heapq.heappush(cheapest, entry)
        if room[s]:
            heapq.heappush(cheapest, (cost + linear * n + quadratic * n * n, s))
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document (``doc_id``, ``text``); with ``with_ids`` also the piece's ``ids``.

    A null or empty text is the end mark (id 0) alone.  Repeated rows and rows without ``doc_id`` are packed like others.  Sequence ids are
    unique, not gapless: the task's number and a counter.  ``tokenizer`` is a path every executor can read.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def flush(held: list[tuple[int | None, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        out: dict[str, list] = {c: [] for c in schema.names}

        def add(doc: int, start: int, n: int, sequence: int, offset: int) -> None:
            ids = held[doc][1][start : start + n]
            row = (held[doc][0], start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(held[doc][1]), sequence, offset)
            for c, v in zip(schema.names, row, strict=False):
                out[c].append(v)
            if with_ids:
                out["ids"].append(ids.astype(np.int32))

        rest = []
        for d, (_, ids) in enumerate(held):
            whole = len(ids) // length
            for k in range(whole):
                add(d, k * length, length, first, 0)
                first += 1
            rest.append(len(ids) - whole * length)
        placed = sorted(place(rest, length, linear, quadratic))
        ends = [b[1] if a[0] == b[0] else rest[a[0]] for a, b in zip(placed, [*placed[1:], (-1, 0, 0, 0)], strict=True)]
        for (d, start, s, offset), end in zip(placed, ends, strict=True):
            add(d, len(held[d][1]) - rest[d] + start, end - start, first + s, offset)
        used = max((s for _, _, s, _ in placed), default=-1) + 1
        return pa.RecordBatch.from_pydict(out, schema=schema), first + used

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        first = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for piece in all_pieces(batches):
            texts = ["" if t is None else t for t in piece.column("text").to_pylist()]
            held.extend(zip(piece.column("doc_id").to_pylist(), ids.of(texts), strict=True))
            size += piece.nbytes
            if size >= FLUSH_BYTES:
                batch, first = flush(held, first)
                yield batch
                held, size = [], 0
        if held:
            yield flush(held, first)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, OUT + (", ids array<int>" if with_ids else ""))
