"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans.  The field adds spans that the patterns do not know (a telephone number without
its plus, a card number with unusual separators).  It labels *neighbourhoods*: words that hold a digit or an at sign,
and up to ``REACH`` words on either side; elsewhere no label is possible.  It is trained once, on the driver, from the
small table ``LABELLED`` and at most ``SAMPLE`` neighbourhoods whose labels are the base spans; the weights (a few
thousand numbers) travel to the tasks with the function.  Viterbi runs over all neighbourhoods of a block at once in numpy.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_SPACE, Block, Words, all_pieces, pieces, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
REACH = 2
SAMPLE = 1500  # neighbourhoods from the corpus, at most; each cut to TRAIN_WORDS words for training only
TRAIN_WORDS = 24
FEATURES = 4096
EPOCHS = 60
KEPT_CHARS = 64  # features of words up to this length are remembered, those of longer ones computed each time
MOST_DIGITS = 19  # of a span of the field
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# Labelled examples: words with their label after a slash, "other" left out.
LABELLED = """
call me at (030)/phone 555-0142/phone after noon
office: 030/phone 555/phone 0199/phone ext. 12
tel 555-867-5309/phone or write
mobile (456)/phone 555-2186/phone thanks
fax 1/phone (212)/phone 555-0175/phone
reach us under 0049/phone 30/phone 5550123/phone today
on 12 May 1998 we sold 150 tables
chapter 12.4 of the 2019 edition, page 331
room 14, floor 3, building 7
version 3.2.1 of 2021-04-05 is out
price 1,299.00 and 24 months
order 20190413 has 7 items
card 4111.1111.1111.1111/card on file
card 4012/card 8888/card 8888/card 1881/card expires 12/27
server 10.0.0.17/ip port 8080
write to jane.doe@example.org/email soon
"""

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits that fails at its first digit fails at all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = " \t\n\r.,;:!?\"'<>[]{}#*$%&|"


def luhn(digits: str) -> bool:
    double = str.maketrans("0123456789", "0246813579")
    return sum(map(int, digits[-1::-2])) % 10 == -sum(map(int, digits[-2::-2].translate(double))) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each holds exactly one at sign, so the local part is what stands before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in code points, in the order of ``KINDS``."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out[3].append(m.span())
    return out


def shape(word: str) -> str:
    """The whole word: letters as X and x (runs as one), digits as d (runs counted up to nine), other characters as they are."""
    out: list[str] = []
    run = 0
    for c in word:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c if c < "\x7f" else "o"
        run = run + 1 if out and out[-1] == s else 1
        if run == 1 or s == "d" and run <= 9:
            out.append(s)
    return "".join(out)


def _word_features(word: str) -> tuple[int, ...]:
    return _kept_features(word) if len(word) <= KEPT_CHARS else _new_features(word)


def _new_features(word: str) -> tuple[int, ...]:
    core = word.strip(_EDGE)
    s, digits = shape(core), _digits(core)
    long_ = 13 <= len(digits) <= 19
    names = [
        f"shape {s}", f"outline {re.sub('d+', 'd', s)}", f"first {s[:1]}", f"last {s[-1:]}", f"at {'@' in core}", f"dots {core.count('.')}",
        f"digits {min(len(digits), 20)}", f"luhn {long_ and luhn(digits)} {long_}", f"only {core.isdigit()}", f"edge {word[-1:] in _EDGE}",
    ]
    return tuple(zlib.crc32(n.encode()) % FEATURES for n in names)


_kept_features = lru_cache(maxsize=1 << 16)(_new_features)


def features(words: list[str]) -> np.ndarray:
    """Feature numbers of each word: its own, and its neighbours' moved to numbers of their own."""
    own = np.array([_word_features(w) for w in words], dtype=np.int64).reshape(len(words), -1)
    none = np.full((1, own.shape[1]), FEATURES - 1)
    before, behind = np.concatenate((none, own[:-1])), np.concatenate((own[1:], none))
    return np.concatenate((own, (before * 31 + 7) % FEATURES, (behind * 37 + 11) % FEATURES), axis=1)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), size.max(), sequences[0].shape[1]), dtype=np.int64)
    for k, s in enumerate(sequences):
        out[k, : len(s)] = s
    return out, size


class Field:
    """Weights of the field: ``emit`` by feature and label, ``step`` by pair of neighbouring labels."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each sequence; sequences of similar length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sequences)
        by = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        place = 0
        while place < len(by):
            stop = place + 1
            while stop < len(by) and stop - place < 4096 and len(sequences[by[stop]]) <= 2 * len(sequences[by[place]]) + 4:
                stop += 1
            rows = by[place:stop]
            x, size = _padded([sequences[i] for i in rows])
            best = self.emit[x[:, 0]].sum(axis=1)
            back = np.zeros((x.shape[1], len(rows), len(LABELS)), dtype=np.int8)
            for t in range(1, x.shape[1]):
                total = best[:, :, None] + self.step
                back[t] = total.argmax(axis=1)
                moved = total.max(axis=1) + self.emit[x[:, t]].sum(axis=1)
                live = (t < size)[:, None]
                best = np.where(live, moved, best)
                back[t] = np.where(live, back[t], np.arange(len(LABELS)))
            label = best.argmax(axis=1)
            labels = np.zeros((len(rows), x.shape[1]), dtype=np.int64)
            for t in range(x.shape[1] - 1, -1, -1):
                labels[:, t] = label
                label = back[t][np.arange(len(rows)), label]
            for k, i in enumerate(rows):
                out[i] = labels[k, : size[k]]
            place = stop
        return out


def train(examples: list[tuple[list[str], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps on the whole (bounded) set, forward and backward sums in numpy."""
    x, size = _padded([features(w) for w, _ in examples])
    n, longest = x.shape[:2]
    y = np.zeros((n, longest), dtype=np.int64)
    for k, (_, labels) in enumerate(examples):
        y[k, : len(labels)] = labels
    live = np.arange(longest) < size[:, None]
    emit, step = np.zeros((FEATURES, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    seen_emit, seen_step = np.full_like(emit, 1e-6), np.full_like(step, 1e-6)
    one = np.eye(len(LABELS))
    used = x[live]  # features of the words, padding left out
    for _ in range(epochs):
        score = np.zeros((n, longest, len(LABELS)))
        score[live] = sum(emit[used[:, f]] for f in range(used.shape[1]))
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            sums = np.logaddexp.reduce(forward[:, t - 1, :, None] + step, axis=1) + score[:, t]
            forward[:, t] = np.where(live[:, t, None], sums, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            sums = np.logaddexp.reduce(step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(live[:, t + 1, None], sums, 0.0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        wrong = (np.exp(forward + backward - z[:, None, None]) - one[y])[live]
        g_emit = np.stack([np.bincount(used.ravel(), weights=np.repeat(w, used.shape[1]), minlength=FEATURES) for w in wrong.T], axis=1)
        both = live[:, 1:, None, None]
        pair = np.exp(forward[:, :-1, :, None] + step + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g_step = ((pair - one[y[:, :-1]][..., None] * one[y[:, 1:]][:, :, None, :]) * both).sum(axis=(0, 1))
        for w, g, seen in ((emit, g_emit / n + decay * emit, seen_emit), (step, g_step / n, seen_step)):
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return Field(emit, step)


def neighbourhoods(words: Words) -> list[tuple[int, int]]:
    """Word ranges around the words that hold a digit or an at sign; ranges of one text that touch are one."""
    data = words.block.data
    marks = np.flatnonzero(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))
    at = np.unique(np.searchsorted(words.start, marks, side="right") - 1)
    if not len(at):
        return []
    text = words.text[at]
    low, high = np.maximum(at - REACH, words.first[text]), np.minimum(at + REACH + 1, words.first[text + 1])
    fresh = np.append(True, (low[1:] > high[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(low[first].tolist(), high[last].tolist(), strict=True))


class Located:
    """A block's texts, words and neighbourhoods, with code-point places."""

    def __init__(self, texts: list[bytes]):
        self.raw = texts
        self.words = Words.of(Block.of(texts), NOT_SPACE)
        self.ranges = neighbourhoods(self.words)
        self.data = self.words.block.data.tobytes()

    def tokens(self, a: int, b: int) -> list[str]:
        return [self.data[s:e].decode() for s, e in zip(self.words.start[a:b].tolist(), self.words.end[a:b].tolist(), strict=True)]

    def place(self, byte: int, text: int) -> int:
        return len(self.data[int(self.words.block.start[text]) : byte].decode())


def _parse(lines: str) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in filter(None, map(str.strip, lines.split("\n"))):
        pairs = [w.rpartition("/") if w.rpartition("/")[2] in KINDS else (w, "/", "other") for w in line.split()]
        out.append(([p[0] for p in pairs], [LABELS.index(p[2]) for p in pairs]))
    return out


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[list[str], list[int]]]:
    """At most ``sample`` neighbourhoods with the base spans as labels, chosen by hash of the row."""
    n = docs.count()
    every = max(1, n // sample)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in all_pieces(batches):
            found = Located(text_bytes(piece.column("text")))
            rows: dict[str, list] = {"h": [], "words": [], "labels": []}
            spans: dict[int, list[list[tuple[int, int]]]] = {}
            for a, b in found.ranges:
                b = min(b, a + TRAIN_WORDS)
                text = int(found.words.text[a])
                if text not in spans:
                    spans[text] = base_spans(found.raw[text].decode())
                start = found.place(int(found.words.start[a]), text)
                words, labels = found.tokens(a, b), []
                for k, w in enumerate(words):
                    if k:
                        start += len(found.data[int(found.words.end[a + k - 1]) : int(found.words.start[a + k])].decode())
                    hit = [i + 1 for i, s in enumerate(spans[text]) for x, y in s if x < start + len(w) and y > start]
                    labels.append(hit[0] if hit else 0)
                    start += len(w)
                line = " ".join(words)
                rows["h"].append(zlib.crc32(line.encode()))
                rows["words"].append(line)
                rows["labels"].append(labels)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("h", pa.int64()), ("words", pa.string()), ("labels", pa.list_(pa.int32()))]))

    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")
    return [(r[1].split(" "), list(r[2])) for r in part.mapInArrow(label, "h long, words string, labels array<int>").orderBy("h", "words").limit(sample).collect()]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Field trained on the labelled table and the bounded sample; telephone numbers also without their plus."""
    examples = _parse(LABELLED) * 8 + training_rows(docs, sample)
    phone = LABELS.index("phone")
    bare = [([w.removeprefix("+") if k == phone else w for w, k in zip(words, labels, strict=True)], labels) for words, labels in examples if phone in labels]
    return train(examples + [e for e in bare if all(e[0])])


def _valid(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return text.count("@") == 1 and not text.startswith("@") and not text.endswith("@")
    if kind == "ip":
        return len(parts := text.split(".")) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in text)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)


def _trimmed(found: Located, a: int, b: int) -> tuple[int, str]:
    """Words ``a`` to ``b`` without punctuation around them: how much goes on the left, and what is left."""
    piece = found.data[int(found.words.start[a]) : int(found.words.end[b - 1])].decode()
    return len(piece) - len(piece.lstrip(_EDGE)), piece.strip(_EDGE)


def field_spans(found: Located, field: Field) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) in code points that the field finds, by text of the block.

    Neighbouring words of one kind are one span where that is valid; else the run is read as several, each as long as it can be.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not found.ranges:
        return out
    tokens = [found.tokens(a, b) for a, b in found.ranges]
    for (a, _), words, labels in zip(found.ranges, tokens, field.viterbi([features(w) for w in tokens]), strict=True):
        k = 0
        while k < len(words):
            stop, best, digits = k, None, 0
            while labels[k] and stop < len(words) and labels[stop] == labels[k]:
                digits += len(_digits(words[stop]))
                if digits > MOST_DIGITS and stop > k:
                    break
                stop += 1
                lead, core = _trimmed(found, a + k, a + stop)
                if core and _valid(LABELS[labels[k]], core):
                    best = (stop, lead, len(core))
            if best:
                text = int(found.words.text[a])
                start = found.place(int(found.words.start[a + k]), text) + best[1]
                out.setdefault(text, []).append((int(labels[k]) - 1, start, start + best[2]))
            k = best[0] if best else k + 1
    return out


def _all_spans(found: Located, field: Field) -> Iterator[tuple[str, list[list[tuple[int, int]]], list[tuple[int, int, int]]]]:
    """For each text: the text, its base spans by kind, and all spans in order (the field's never overlap base spans)."""
    more = field_spans(found, field)
    for i, raw in enumerate(found.raw):
        text = raw.decode()
        base = base_spans(text)
        spans = [(k, *s) for k, own in enumerate(base) for s in own]
        yield text, base, sorted(spans + [m for m in more.get(i, []) if not any(m[1] < b and m[2] > a for _, a, b in spans)])


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data of every row of ``docs`` (``doc_id``, ``text``): counts and digest of the base spans, and all spans.

    A null text is empty; repeated rows and rows without ``doc_id`` are judged like others; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = field or fit(rows)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in all_pieces(batches):
            out: dict[str, list] = {c: [] for c in schema.names}
            for _, base, every in _all_spans(Located(text_bytes(piece.column("text"))), field):
                for own, name in zip(base, KINDS, strict=True):
                    out[f"n_{name}"].append(len(own))
                out["base_sha256"].append(hashlib.sha256(_joined((k, *s) for k, own in enumerate(base) for s in own).encode()).hexdigest())
                out["spans"].append(_joined(every))
            yield pa.RecordBatch.from_pydict(out | {"doc_id": piece.column("doc_id")}, schema=schema)

    return rows.mapInArrow(run, OUT)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` (overlapping ones as one) replaced by its kind in brackets.

    Other columns stay; ``n_chars``, where it is a column, follows the new text.  A null text stays null.
    """
    field = field or fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        out: list[str | None] = []
        batch = pa.record_batch({"text": pa.array(values, type=pa.string())})
        for piece in pieces(batch):
            for text, _, every in _all_spans(Located(text_bytes(piece.column("text"))), field):
                kept, place = [], 0
                for k, a, b in sorted(every, key=lambda s: (s[1], s[0])):
                    if a >= place:
                        kept += [text[place:a], f"[{KINDS[k].upper()}]"]
                    place = max(place, b)
                out.append("".join(kept) + text[place:])
        return pd.Series(out, dtype=object).where(values.notna().to_numpy(), None)

    done = docs.withColumn("text", clean(F.col("text").cast("string")))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
