"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def near_copies(rows):
    """{(doc_id, text)}: fingerprint and component, by comparing all pairs."""
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        names = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(n >> b & 1 for n in names) > len(names)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(rows, prints, group, strict=True)]


def licences(rows):
    out = []
    for doc, text in rows:
        words, places, labels = ALNUM.findall(lower(text or "")), [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out


def urls(rows):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    out = []
    for page, url in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = lower(host)
        fit = max((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        out.append((page, host, path, fit and fit[1] + fit[2], fit and fit[0]))
    return out


def windows_removed(rows):
    least, words = {}, [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, w in words:
        for i in range(len(w) - 12 if doc is not None else 0):
            least[tuple(w[i : i + 13])] = min(least.get(tuple(w[i : i + 13]), doc), doc)
    out = []
    for doc, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12 if doc is not None else 0):
            if least[tuple(w[i : i + 13])] < doc:
                gone[i : i + 13] = [True] * 13
        out.append((doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def strings_removed(rows):
    count, texts = collections.Counter(), [(doc, (text or "").encode()) for doc, text in rows]
    for _, t in texts:
        count.update(t[i : i + 400] for i in range(len(t) - 399))
    out = []
    for doc, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(rows):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for doc, text in rows:
        text = text or ""
        found = [
            [m.span() for m in email.finditer(text)],
            [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
            [m.span() for m in card.finditer(text) if 13 <= len(digits(m.group())) <= 19 and _luhn(digits(m.group()))],
            [m.span() for m in phone.finditer(text) if 9 <= len(digits(m.group())) <= 15],
        ]
        base = ",".join(f"{k}:{a}:{b}" for k, own in zip(("email", "ip", "card", "phone"), found, strict=True) for a, b in own)
        out.append((doc, *map(len, found), sha(base.encode())))
    return out


def contamination(rows, items):
    tests = []
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        tests += [(str(item), w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w and item is not None else []
    out = []
    for doc, text in rows:
        w, names = ALNUM.findall(lower(text or "")), set()
        hit = [False] * len(w)
        for item, gram in tests:
            for i in range(len(w) - len(gram) + 1):
                if w[i : i + len(gram)] == gram:
                    names.add(item)
                    hit[i : i + len(gram)] = [True] * len(gram)
        out.append((doc, len(w), sum(hit), len(names), sha(",".join(sorted(names)).encode()), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def phrase_matches(rows, items):
    tests = set()
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        tests |= {(str(item), tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12))} if w and item is not None else set()
    for doc, text in rows:
        w = tuple(ALNUM.findall(lower(text or "")))
        yield from {(doc, item, i, len(gram)) for item, gram in tests for i in range(len(w) - len(gram) + 1) if w[i : i + len(gram)] == gram}


def measures(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w = SPACED.findall(text)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if SPACED.search(line)]
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), failed))
    return out
