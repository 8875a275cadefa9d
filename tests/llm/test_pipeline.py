"""Every stage of the pipeline against plain Python on the smallest tables and awkward rows."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from amtskompass.llm import packing, quality, simhash

from . import plain
from .test_llm_operators import ROWS, check_packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    odd = [(10_000 + k, t, "en", "odd", len(t or "")) for k, (_, t) in enumerate(ROWS)]
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    """Input and output of every stage, written and read as the pipeline does."""
    folder, out, docs = tmp_path_factory.mktemp("stages"), [], documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_keep_the_columns(stages, documents):
    assert [n for n, _, _ in stages] == ["quality rules", "near-dedup", "decontamination", "personal data", "packing"]
    for _, _, after in stages[:-1]:
        assert after.columns == documents.columns and after.count() > 0


def test_quality_stage(stages):
    _, before, after = stages[0]
    kept = {(r["doc_id"], r["text_hash"]) for r in quality.judged(before).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == {d for d, _ in kept}
    failed = {m[0] for m in plain.measures([(r["doc_id"], r["text"]) for r in before.collect()]) if m[-1]}
    assert not failed & {r["doc_id"] for r in after.collect()}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_no_two_similar_documents_stay(stages):
    _, _, after = stages[1]
    sets = [shingles(t) for _, t in pairs(after)]
    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = collections.Counter((a, b) for own in where.values() for i, b in enumerate(own) for a in own[:i])
    assert all(n / len(sets[a] | sets[b]) < 0.85 for (a, b), n in common.items())


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    bad = {m[0] for m in plain.contamination(pairs(before), items) if m[-1]}
    assert pairs(after) == [p for p in pairs(before) if p[0] not in bad]


def test_personal_data_stage(stages):
    _, before, after = stages[3]
    assert [d for d, _ in pairs(before)] == [d for d, _ in pairs(after)]
    assert all(m[1:5] == (0, 0, 0, 0) for m in plain.personal(pairs(after)))
    found = {m[0] for m in plain.personal(pairs(before)) if any(m[1:5])}
    old, new = dict(pairs(before)), dict(pairs(after))
    assert found and all(old[d] != new[d] for d in found)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_packing_stage(stages):
    _, before, after = stages[4]
    rows = pairs(before)
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for _, t in rows}
    total, sequences = check_packing(rows, [r.asDict() for r in after.collect()], ids)
    assert sequences * packing.LENGTH < 1.1 * total + 8 * packing.LENGTH


def test_run_gives_the_last_stage(spark):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
    assert {r[0] for r in corpus_pipeline.run(spark, SF_DIR).select(*columns).collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_table(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_similarity_of_near_copies_is_exact(spark):
    """Planted pairs around 0.8, and texts that share only one line, said many times."""
    rnd, rows, gone = random.Random(21), [], set()
    word = lambda: f"w{rnd.randrange(10**6)}"
    for k in range(120):
        own = [word() for _ in range(300)]
        n = 32 if k % 2 else 37  # words replaced at the end: Jaccard 264/328 = 0.805 and 259/333 = 0.778
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 300 - n] + [word() for _ in range(n)]))]
        gone |= {2 * k + 1} if k % 2 else set()
    line = " ".join(word() for _ in range(10))
    rows += [(1000 + k, "\n".join([" ".join(word() for _ in range(300)), *[line] * 30])) for k in range(40)]
    sets = {d: shingles(t) for d, t in rows}
    assert {b for a, b in ((2 * k, 2 * k + 1) for k in range(120)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} == gone
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {d for d, _ in rows} - kept == gone


def test_large_groups_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_SETS", 5)
    rnd = random.Random(22)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(60):  # a chain of copies that drift apart, and unlike its start in the end
        base = base[:]
        at = rnd.randrange(190)
        base[at : at + 3] = [f"v{rnd.randrange(10**6)}" for _ in range(3)]
        rows.append((k, " ".join(base)))
    rows += [(100, ""), (101, None), (102, " \n")]
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {0, 100}


def test_near_dedup_stage_by_all_pairs_of_sets(stages):
    _, before, after = stages[1]
    rows = pairs(before)
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    first = {}
    for g, row in zip(group, rows, strict=True):
        first.setdefault(g, []).append(row)
    assert pairs(after) == sorted((min(own) for own in first.values()), key=repr)


def test_columns_named_like_internal_ones_stay(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "x", 1, "k"), (2, "a b c d e f", "y", 2, "k"), (3, "other", "z", 3, "k")], "doc_id long, text string, _kept_key string, _copy int, _row_key string")
    assert sorted(map(tuple, simhash.first_of_each(rows).collect())) == [(1, "a b c d e f", "x", 1, "k"), (3, "other", "z", 3, "k")]
    keys = rows.where("doc_id > 1").select("doc_id", F.xxhash64("text").alias("text_hash"))
    assert sorted(r["_row_key"] + r["_kept_key"] for r in corpus_pipeline._rows_of(rows, keys).collect()) == ["ky", "kz"]


def test_packed_names_keep_sizes_and_overlaps():
    rnd = np.random.default_rng(3)
    names = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    a, b = (simhash.unpacked(simhash.packed(x)) for x in (names[:3000], np.append(names[1000:], names[:5])))
    assert len(a) == 3000 and len(b) == 4005 and len(np.intersect1d(a, b)) == 2005
    assert len(simhash.unpacked(simhash.packed(names[:0]))) == 0


def some_texts(seed, unrelated, copies):
    """Unrelated texts, all with the same two lines, and chains of near copies of some of them."""
    rnd = random.Random(seed)
    line = "\n".join(" ".join(f"c{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(2))
    rows = [(k, "\n".join([" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40, 120))), line])) for k in range(unrelated)]
    for k in range(copies):
        words = rows[rnd.randrange(5)][1].split(" ")
        for at in rnd.sample(range(len(words)), k % 3):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(words)))
    return rows


def first_by_all_pairs(rows, similarity=0.8):
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, d), d)
    return set(least.values())


def test_candidates_do_not_grow_with_all_pairs(spark):
    """Of 400 texts that all share two lines only those with a near copy are compared with anything."""
    rows = some_texts(31, 400, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    blocks = simhash.prefix_blocks(docs, 5, 0.8, simhash.common_shingles(docs, 5), 3).collect()
    compared = {i for r in blocks for i in r["ids"]}
    assert all(1 < len(r["ids"]) <= 35 and r["chunks"] == 1 for r in blocks)
    assert 5 < len(compared) <= 35
    kept = {r["doc_id"] for r in simhash.first_of_each(docs).collect()}
    assert kept == first_by_all_pairs(rows)


def test_frequent_prefix_shingles_are_compared_in_chunks(spark, monkeypatch):
    rows = some_texts(32, 60, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "BLOCK_SETS", 3)
    nothing = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int16)
    assert max(r["chunks"] for r in simhash.prefix_blocks(docs, 5, 0.8, nothing, 2).collect()) > 3
    monkeypatch.setattr(simhash, "common_shingles", lambda docs, shingle: nothing)  # any order of shingles gives the same groups
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == first_by_all_pairs(rows)


def test_common_shingles_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c d e f h"), (4, None), (5, "a b c d e f")], "doc_id long, text string").coalesce(1)
    names, level = simhash.common_shingles(docs, 5)
    first, second = simhash.distinct_names([b"a b c d e"], 5)[0][0], simhash.distinct_names([b"b c d e f"], 5)[0][0]
    assert dict(zip(names.tolist(), level.tolist(), strict=True)) == {int(first): 12, int(second): 8}
    assert simhash.common_shingles(docs, 5, 1)[0].tolist() == [first]
    assert len(simhash.common_shingles(docs, 5, 0)[0]) == 0


def test_prefixes_of_similar_sets_share_a_name():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        n = int(rnd.integers(1, 80))
        common = int(rnd.integers(1, n + 1))
        pool = rnd.permutation(rnd.integers(0, 1 << 63, 200).astype(np.uint64))
        a, b = np.sort(pool[:n]), np.sort(np.append(pool[:common], pool[n : n + int(rnd.integers(0, 20))]))
        table = np.sort(rnd.choice(pool[: n + 20], int(rnd.integers(0, n)), replace=False))
        level = rnd.integers(8, 11, len(table)).astype(np.int16)
        marks = simhash.prefix_marks(np.append(a, b), np.array([len(a), len(b)]), 0.8, (table, level))
        both = len(np.intersect1d(a, b))
        own, other = a[marks[: len(a)]], b[marks[len(a) :]]
        assert len(own) == len(a) - int(np.ceil(0.8 * len(a) - 1e-6)) + 1 and len(other) == len(b) - int(np.ceil(0.8 * len(b) - 1e-6)) + 1
        if both >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(own, other))


def test_near_forest_connects_what_all_pairs_do():
    rnd = np.random.default_rng(6)
    for across in (False, True):
        words = rnd.integers(0, 1 << 63, (6, 4)).astype(np.uint64)[rnd.integers(0, 6, 60)] ^ (np.uint64(1) << rnd.integers(0, 64, (60, 4)).astype(np.uint64))
        size, side = rnd.integers(80, 120, 60), (np.arange(60) < 25) & across
        found = simhash.near_forest(words, size, side, 6, 0.8)
        label = list(range(60))
        for i in range(60):
            for j in range(i):
                near = int(np.bitwise_count(words[i] ^ words[j]).sum()) <= 6 and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1
                if near and (not across or side[i] != side[j]):
                    label = [label[j] if x == label[i] else x for x in label]
        own = list(range(60))
        for i, j in found:
            own = [own[j] if x == own[i] else x for x in own]
        assert {tuple(k for k in range(60) if label[k] == x) for x in label} == {tuple(k for k in range(60) if own[k] == x) for x in own}


def test_distinct_names_tell_what_shingle_names_tell():
    texts = [b"", b" \n\t", b"a", b"A b", b"a  B", b"a b c d e", b"a b c d e f\x0bg", b"x a b c d e", b"a b c d e a b c d e", "Ä b c d e f".encode(), "ä b c d e f".encode(), b"ab c d e f", b"a bc d e f"]
    old = [np.unique(simhash.shingle_names(t, 5)) for t in texts]
    new = simhash.distinct_names(texts, 5)
    assert [len(s) for s in old] == [len(s) for s in new]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(old[i], old[j])) == len(np.intersect1d(new[i], new[j]))
