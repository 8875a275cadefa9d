"""Operators against plain Python on a small awkward table: nulls, empty and long texts, ties, repeated rows, other columns."""

from __future__ import annotations

import collections
import random
import textwrap
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from amtskompass.llm import crf, inverted, licenses, packing, quality, recompress, sharding, simhash, suffixes, urls
from amtskompass.llm.blocks import mix

from . import plain

SCHEMA = "part int, doc_id long, text string, words string, n_words string, key string, shard string, name int, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "ÉTÉ", "straße", "日本語", "naïve"]
    prose = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(60, 220))) + "." for _ in range(14)]
    odd = [
        None, "", " ", "\n\t\x0b\x0c\r ", "one", "one two", "A a A a A a " * 40, "same " * 300, "x" * 3000, "\u212aelvin \u0130stanbul CC BY cc by",
        "All rights reserved.\nLicensed under the Apache License, Version 2.0.\nALL RIGHTS RESERVED", "GNU General Public License, version 3 " + prose[0],
        "Licensed under CC BY-NC 4.0. " + prose[1], "mail a.b@c.de, x@y, +49 (0)30 5550142, 4111 1111 1111 1111 and 1.2.3.4 or 1.2.3.999 " + prose[2],
        "a@b@c.d e@f.g@h.i 10.0.0.1.2 0000000000000 12345 +1 2 +" + "9" * 40 + " 1" * 30, "#*$ | | <b> </b> %%% &&& \n a\n a\n b\n\n a", "\x00 nul \x1c sep \x85 nel \u00a0 nbsp \u2003 em",
        "😀" * 200 + " 👩‍👩‍👧 é e\u0301", "<|endoftext|> is text",
    ]
    rows: list[tuple[int | None, str | None]] = list(enumerate(odd)) + [(100 + i, p) for i, p in enumerate(prose)]
    for i, p in enumerate(prose):  # exact copies, near copies, shared passages
        rows.append((200 + i, p))
        words = p.split()
        words[len(words) // 2] = "changed"
        rows.append((300 + i, " ".join(words)))
        rows.append((rnd.choice([None, 400 + i, 5]), prose[(i + 3) % 14][:450] + "\n" + p[100:700]))
    return rows + rows[:3] + rows[20:24] + [(500, prose[3] * 60)]


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, d, t, "w", "n", "k", "s", 3, len(t or "")) for d, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, columns, want):
    assert got(df, *columns) == sorted(want, key=repr)


# ---- packing


def check_packing(rows, pieces, ids):
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_document[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= packing.LENGTH
    want, have = collections.Counter(), collections.Counter()
    for doc, text in rows:
        want[doc] += len(ids[text])
    for doc, own in by_document.items():
        have[doc] = sum(r["length"] for r in own)
        known = [ids[t] for d, t in rows if d == doc]
        assert all(any(zlib.crc32(np.array(i[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(i) == r["doc_tokens"] for i in known) for r in own)
    assert have == want
    return sum(have.values()), len(by_sequence)


def test_packing(docs, nothing):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ROWS}
    pieces = [r.asDict() for r in packing.pack(docs.coalesce(1), TOKENIZER).collect()]
    total, sequences = check_packing(ROWS, pieces, ids)
    assert sequences == -(-total // packing.LENGTH)  # one task: no more sequences than needed
    assert packing.pack(nothing, TOKENIZER).count() == 0
    with_ids = packing.pack(docs.limit(3), TOKENIZER, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def test_placing_balances_cost():
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 1023) for _ in range(800)]
    placed = packing.place(sizes, 1024)
    used, cost = collections.Counter(), collections.Counter()
    for i, (d, start, s, offset) in enumerate(sorted(placed)):
        after = sorted(placed)[i + 1] if i + 1 < len(placed) else (-1, 0)
        n = (after[1] if after[0] == d else sizes[d]) - start
        assert n > 0
        used[s] += n
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert sum(used.values()) == sum(sizes) and max(used.values()) <= 1024 and len(used) == -(-sum(sizes) // 1024)
    room, filled = [], []  # against first fit, longest first, which looks at tokens alone
    for n in sorted(sizes, reverse=True):
        at = next((k for k, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(1024)
            filled.append(0.0)
        room[at] -= n
        filled[at] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert np.std(list(cost.values())) < np.std(filled)


# ---- near copies


def test_near_copies(docs, nothing):
    found = simhash.near_duplicates(docs).selectExpr("doc_id", "lower(hex(fp)) fingerprint", "component_id")
    same(found, ("doc_id", "fingerprint", "component_id"), plain.near_copies(ROWS))
    assert simhash.near_duplicates(nothing).count() == 0


def test_tiles_find_all_links(spark):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(300)}
    values |= {v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in rnd.sample(sorted(values), 120)} | {0, (1 << 64) - 1, 1 << 63}
    nodes = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in sorted(values)], "fp binary")
    links = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in simhash.links(nodes, 2, tile=16).collect()]

    def groups(edges):
        of = {v: v for v in values}
        for a, b in edges:
            old, new = of[a], of[b]
            of = {v: new if g == old else g for v, g in of.items()}
        return {frozenset(v for v in values if of[v] == g) for g in set(of.values())}

    ordered = sorted(values)
    assert groups(links) == groups([(a, b) for i, a in enumerate(ordered) for b in ordered[:i] if (a ^ b).bit_count() <= 2])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 100)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (200, 100)}


def test_one_of_each_group_stays(docs, nothing):
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and simhash.first_of_each(nothing).count() == 0
    rows = got(kept, "doc_id", "text")
    assert len(rows) == len(set(rows))
    for i in range(14):
        assert not any(d == 200 + i for d, _ in rows), "an exact copy stayed"


# ---- licences


def test_licences(docs, nothing):
    same(licenses.scanned(docs), ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), plain.licences(ROWS))
    for r in licenses.scanned(docs).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.scanned(nothing).count() == 0


def test_template_join_is_exact(spark):
    rnd = random.Random(9)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["foo", "bar"]
    texts = []
    for k in range(200):
        label, template = rnd.choice(licenses.TEMPLATES)
        words = [w for w in template.split() if rnd.random() < 0.85] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))]
        rnd.shuffle(words)
        texts.append((str(k), "\n".join([" ".join(words), "foo bar", " ".join(rnd.choice(vocabulary) for _ in range(8))])))
    df = spark.createDataFrame(texts, "key string, text string")
    frequency = licenses.term_frequencies(df, sorted({w for _, t in licenses.TEMPLATES for w in t.split()}))
    found = {(r["key"], r["label"]): r["share"] for r in licenses.template_matches(df, frequency).collect()}
    want = {}
    for key, text in texts:
        for label, template in licenses.TEMPLATES:
            terms = set(template.split())
            share = max(len(terms & set(plain.ALNUM.findall(line))) / len(terms) for line in text.split("\n"))
            if share >= licenses.CONTAINMENT:
                want[key, label] = share
    assert found == want


def test_wrapped_notices(spark):
    """Notices wrapped at 80 characters and at every word, alone and at each place of a long text."""
    notices, rows = dict(licenses.TEMPLATES), []
    for k, label in enumerate(("mit", "bsd", "gpl-3.0")):
        rows += [(10 * k, textwrap.fill(notices[label].capitalize(), 80)), (10 * k + 1, notices[label].replace(" ", "\n"))]
        for at in (100, 120, 250, 380):
            filler = [f"f{i}" for i in range(600)]
            rows.append((10 * k + 2 + at // 60, textwrap.fill(" ".join([*filler[:at], notices[label], *filler[at:]]), 80)))
    rows.append((99, "permission is\nhereby granted"))
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(("mit", "bsd", "gpl-3.0")):
        own = [found[d] for d, _ in rows if 10 * k <= d < 10 * k + 10]
        assert len(own) == 6 and all(label in labels.split(",") and score == 1.0 for labels, score in own)
    assert found[99] == ("", 0.0)


def test_licence_scan_reads_the_table_once(spark):
    """One pass, and no notice lost by what it notes about each text: any case, other gaps, neighbours beyond ASCII, too few words."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    notices = [n for _, n in licenses.TEMPLATES]
    texts = [n.upper().replace(" ", " \x00-_\n") for n in notices] + [f"\u00e9 {n} \u212a" for n in notices] + [f"\u00e9{n}\u00e9" for n in notices]
    texts += [" ".join(n.split()[: len(n.split()) // 2]) for n in notices] + ["All\trights/RESERVED", "all of the rights are reserved", "C\u00c7 BY \u0130 CC, by", None, "", " . "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), "doc_id long, text string")
    found = {r["doc_id"]: r.asDict() for r in licenses.scanned(df).collect()}
    assert read.value == len(rows)
    assert [tuple(found[d][c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for d, _ in rows] == plain.licences(rows)
    for d, text in rows:
        words, base = set(plain.ALNUM.findall(plain.lower(text or ""))), found[d]["base_labels"]
        shares = {label: len(words & set(n.split())) / len(set(n.split())) for label, n in licenses.TEMPLATES}
        near = {label: share for label, share in shares.items() if share >= licenses.CONTAINMENT}
        assert found[d]["labels"] == ",".join(sorted({*near, *filter(None, base.split(","))}))
        assert found[d]["score"] == (1.0 if base else max(near.values(), default=0.0))


# ---- urls


def test_urls(spark):
    rows = [
        (1, "http://EXAMPLE.net/en/1?x#y"), (2, "https://a.b.example.com/de/7#t"), (3, None), (4, "no scheme"), (5, "ftp://"), (6, "x://net"), (7, "http://net/"), (8, "http://internet/"),
        (9, "http://www.org/fr/"), (10, "http://h.org?fr/"), (11, "http://h.com#/de/"), (12, "http://example.com/de"), (12, "http://example.com/de"), (None, "http://q.com/a//b/../c/"), (13, "a://b://c.net/x"),
    ]
    rows += [(100 + i, f"http://shop.com/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(60)]
    pages = spark.createDataFrame([(p, u, "h", 1) for p, u in rows], "page_id long, url string, host string, pages int")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)], "page_id long, bad int")
    found = urls.filtered(pages, labels)
    same(found, ("page_id", "host", "path", "rule"), [r[:4] for r in plain.urls(rows)])
    verdict = {r["page_id"]: (r["rule"], r["verdict"], r["template"]) for r in found.collect()}
    assert all(verdict[p][1] == v for p, _, _, _, v in plain.urls(rows) if v)
    assert {verdict[100 + i][1:] for i in range(60) if i % 2} == {("block", "/spam/*")} and {verdict[100 + i][1:] for i in range(60) if not i % 2} == {("allow", "/news/*")}
    assert {r["verdict"] for r in urls.filtered(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}
    assert urls.filtered(pages.limit(0), labels).count() == 0


# ---- substrings


def test_repeated_windows(docs, nothing):
    same(recompress.removed_windows(docs), ("doc_id", "n_words", "n_removed", "kept_sha256"), plain.windows_removed(ROWS))
    assert recompress.removed_windows(nothing).count() == 0


def test_runs_and_periods(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(150):
        words: list[str] = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.randrange(4)
            words += ["a"] * rnd.randint(1, 40) if kind == 0 else ["a", "b"] * rnd.randint(1, 12) if kind == 1 else [rnd.choice("abc") for _ in range(rnd.randint(1, 30))] if kind == 2 else [f"x{i}" for i in range(rnd.randint(0, 5), rnd.randint(6, 30))]
        rows.append((rnd.choice([None, k, k, k // 2]), rnd.choice([" ", "\n"]).join(words)))
    same(recompress.removed_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), ("doc_id", "n_words", "n_removed", "kept_sha256"), plain.windows_removed(rows))


def test_symbols_depend_on_their_frame_only():
    rnd = np.random.default_rng(3)
    for words in (2, 3, 30):
        for _ in range(200):
            own = rnd.integers(0, words, recompress.WINDOW)
            anchors = set()
            for _ in range(4):
                before, behind = rnd.integers(0, words, rnd.integers(0, 9)), rnd.integers(0, words, rnd.integers(0, 9))
                names = mix(np.concatenate((before, own, behind)).astype(np.uint64))
                named, start = recompress.symbols(names, np.zeros(len(names), dtype=np.int64))
                assert np.diff(np.append(start, len(names))).max() <= recompress.WIDEST and len(named) == len(start)
                anchors.add(int(recompress.window_anchors(names, np.zeros(len(names), dtype=np.int64))[len(before)]))
            assert len(anchors) == 1


def test_repeated_strings(docs, nothing):
    same(suffixes.removed_strings(docs), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), plain.strings_removed(ROWS))
    assert suffixes.removed_strings(nothing).count() == 0


def test_suffix_array():
    rnd = random.Random(0)
    for _ in range(500):
        text = [rnd.randint(0, rnd.randint(1, 4)) for _ in range(rnd.randint(0, 40))]
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_edges_of_repeats(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(1200)) for _ in range(3)]
    rows = []
    for k in range(60):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            x, a = rnd.choice(base), rnd.randint(0, 1000)
            kind = rnd.randrange(4)
            text += "ab" * rnd.randint(1, 500) if kind == 0 else x[a : a + rnd.randint(300, 700)] if kind == 1 else "".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 300))) if kind == 2 else x[:a] + "#" + x[a + 1 :]
        rows.append((k, text))
    same(suffixes.removed_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), plain.strings_removed(rows))


# ---- sharding


def test_shards(docs, nothing):
    rows = [r.asDict() for r in sharding.sharded(docs, 5).collect()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS), key=repr)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    assert sharding.sharded(nothing).count() == 0


def test_linked_documents_stay_together(spark):
    rows = [(i, f"single {i}") for i in range(2000)] + [(3000 + i, f"group {i % 150}") for i in range(600)] + [(9000 + i, "huge") for i in range(1300)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert {r["n"] for r in found.groupBy("shard").count().withColumnRenamed("count", "n").collect()} <= {487, 488}
    groups = collections.defaultdict(set)
    text = dict(rows)
    for r in found.collect():
        groups[text[r["doc_id"]]].add(r["shard"])
    assert all(len(groups[f"group {k}"]) == 1 for k in range(150))
    assert len(groups["huge"]) == 3  # the fewest shards that hold 1300 rows


def test_large_groups_stay_whole(spark):
    """Groups of up to 25,000 copies that fit into a shard; what none of the labels has room for goes to another shard."""
    sizes = [25_000, 24_000, 23_000, 22_000, 3000, 3000, 2000, 10, 2]
    rows = spark.range(sum(sizes) + 2000).selectExpr(
        "id as doc_id",
        "case " + " ".join(f"when id < {sum(sizes[: k + 1])} then 'group {k}'" for k in range(len(sizes))) + " else concat('single ', id) end as text",
    )
    found = sharding.sharded(rows, 4).join(rows, "doc_id")
    groups = {r["text"]: r["n"] for r in found.where("text like 'group%'").groupBy("text").agg({"shard": "approx_count_distinct"}).toDF("text", "n").collect()}
    assert groups == {f"group {k}": 1 for k in range(len(sizes))}
    counts = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1


def test_no_room_for_a_whole_group(spark):
    """Five groups of three in three shards of five: two are cut, and the counts still hold."""
    found = sharding.sharded(spark.createDataFrame([(i, f"group {i // 3}") for i in range(15)], "doc_id long, text string"), 3).collect()
    assert sorted(collections.Counter(r["shard"] for r in found).values()) == [5, 5, 5]
    assert sum(len({r["shard"] for r in found if r["doc_id"] // 3 == g}) == 1 for g in range(5)) >= 3


# ---- personal data


def test_personal_data(docs, nothing):
    found = crf.personal_data(docs)
    same(found, ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), plain.personal(ROWS))
    assert crf.personal_data(nothing).count() == 0


def test_field_finds_what_patterns_miss(spark):
    lines = ["call me at (040) 555-0133 after noon", "call +49 30 5550142 or write", "we sold 1200 units in 1998", "read chapter 12 of 2019"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in crf.personal_data(df).collect()}
    assert spans[0] == "phone:11:25" and spans[1].startswith("phone:5:") and spans[2] == spans[3] == ""
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in crf.redacted(df.selectExpr("doc_id", "text", "length(text) AS n_chars")).collect()}
    assert clean[0] == ("call me at [PHONE] after noon", 29) and clean[2][0] == lines[2]


def test_runs_of_one_kind_are_read_as_several():
    class Fixed:
        def viterbi(self, sequences):
            return [np.array([0, 4, 4, 4, 4, 0, 0, 1, 1]) for _ in sequences]

    line = "call 555-867-5309 (030) 5550142-17, 0171-5550199. or to jane@example.org, joe@example.net"
    spans = crf.field_spans(crf.Located([line.encode()]), Fixed())[0]
    assert [line[a:b] for _, a, b in spans] == ["555-867-5309 (030)", "5550142-17", "0171-5550199", "jane@example.org", "joe@example.net"]


def test_shape_reads_whole_words():
    assert crf.shape("a" * 100 + "7") == "xd" and crf.shape("1" * 100 + "-B") == "d" * 9 + "-X"
    assert crf.features(["x" * 70 + "@a.de"])[0].tolist() != crf.features(["x" * 70])[0].tolist()


def test_field_on_held_out_lines(docs):
    examples = crf._parse(crf.LABELLED)
    field = crf.train(examples[::2] + examples[1::4])
    wrong = total = 0
    for words, labels in examples[3::4]:
        best = field.viterbi([crf.features(words)])[0]
        wrong += sum(int(a) != b for a, b in zip(best, labels, strict=True))
        total += len(words)
    assert wrong <= total // 5


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = crf.Field(rng.normal(size=(crf.FEATURES, 5)), rng.normal(size=(5, 5)))
    sequences = [rng.integers(0, crf.FEATURES, size=(n, 3)) for n in (1, 2, 3, 4, 2)]
    for x, best in zip(sequences, field.viterbi(sequences), strict=True):
        emit = field.emit[x].sum(axis=1)
        paths = np.stack(np.meshgrid(*[range(5)] * len(x), indexing="ij"), axis=-1).reshape(-1, len(x))
        score = emit[np.arange(len(x)), paths].sum(axis=1) + (field.step[paths[:, :-1], paths[:, 1:]].sum(axis=1) if len(x) > 1 else 0)
        assert tuple(paths[score.argmax()]) == tuple(best)


# ---- contamination


def items_of():
    long = [t for _, t in ROWS if t and len(t.split()) > 60]
    return [(1, " ".join(long[0].split()[5:30])), (2, "one two"), (3, None), (4, ""), (5, long[2].upper()), (5, "KELVIN"), (None, "one"), (6, "same same"), (7, " ".join(long[4].split()[:13])), (7, "absent words"), (10, long[3])]


def test_contamination(spark, docs, nothing):
    items = spark.createDataFrame([(i, t, "x") for i, t in items_of()], "item_id long, text string, doc_id string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = plain.contamination(ROWS, items_of())
    same(inverted.contamination(docs, items), columns, want)
    same(inverted.contamination(docs, items, block_words=40), columns, want)  # several blocks of items
    assert inverted.contamination(nothing, items).count() == 0
    same(inverted.contamination(docs, items.limit(0)), columns, plain.contamination(ROWS, []))


def test_matches_are_returned(spark, docs, nothing):
    items = spark.createDataFrame([(i, t, "x") for i, t in items_of()], "item_id long, text string, doc_id string")
    want = collections.Counter(plain.phrase_matches(ROWS, items_of()))
    for block_words in (40, 10_000):
        found = inverted.matches(docs, items, block_words=block_words).where("kind = 'phrase'")
        assert collections.Counter((r["doc_id"], r["item_id"], r["start"], r["length"]) for r in found.collect()) == want
    assert inverted.matches(nothing, items).count() == inverted.matches(docs, items.limit(0)).count() == 0


def test_proximity(spark):
    filler = " ".join(f"f{i}" for i in range(100))
    docs = spark.createDataFrame([(1, f"{filler} delta beta gamma alpha {filler}"), (2, f"alpha {filler} beta {filler} gamma {filler} delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha nowhere"), (3, "f7"), (4, "")], "item_id long, text string")
    assert {(r["doc_id"], r["n_items"], r["n_near_items"]) for r in inverted.contamination(docs, items).collect()} == {(1, 1, 2), (2, 1, 1)}
    near = {(r["doc_id"], r["item_id"], r["start"], r["length"]) for r in inverted.matches(docs, items).where("kind = 'near'").collect()}
    first = 103  # all four terms are equally rare; the item's first one is the start
    assert near == {(1, "1", first, 1)} | {(1, "3", k, 1) for k in (7, 111)} | {(2, "3", k, 1) for k in (8, 109, 210)}


# ---- quality


def test_quality_measures(docs, nothing):
    same(quality.judged(docs), ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), plain.measures(ROWS))
    assert quality.judged(nothing).count() == 0


def test_quality_on_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("not base_failed").collect()
    kept = {side: [r["kept"] for r in judged if labels.get(r["doc_id"]) == side] for side in (0, 1)}
    assert sum(kept[1]) >= 0.98 * len(kept[1]) and sum(kept[0]) <= 0.2 * len(kept[0])
