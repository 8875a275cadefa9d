"""Manifest, exact search and whitening against plain Python on small awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from amtskompass.llm import kdtree, merkle, whitening

DOCS = "steps string, root string, doc_id long, source string, lang string, n_chars long, text string, grp int, h string"
VECTORS = "x int, id long, vec_id long, embedding array<float>, query string, component int"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Last node, and what flanks each leaf and its ancestors."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, p in enumerate(place):
            a = p // 3 * 3
            steps[leaf].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + 3])))
            place[leaf] = p // 3
        nodes = [digest("".join(nodes[a : a + 3])) for a in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text, claimed text)."""
    leaf = lambda r, text: digest("".join(encoded(v) for v in (*r[:4], text)))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r, r[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        done[name] = tree([h for _, h in groups[name]])
    root, upper = tree([done[n][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for (r, h), own in zip(groups[name], done[name][1], strict=True):
            steps = own + upper[at]
            node = leaf(r, r[5])
            for before, after in steps:
                node = digest(before + node + after)
            out.append((r[0], h, done[name][0], root, digest("".join(a + b for a, b in steps)), node))
    return sorted(out, key=repr)


def manifest_rows(n: int, seed: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice([None, "", "a", "ä", "z", "b", *["hot"] * 12])
        text = rnd.choice([None, "", "\n", "one\ntwo", "x" * 50, "ü\n" * 9, "\n" + "long " * 3000])
        rows.append((rnd.choice([None, i, i, i, 7]), source, rnd.choice([None, "de"]), rnd.choice([None, 3]), text))
    return rows + rows[:9]


def got_manifest(spark, rows):
    docs = spark.createDataFrame([("s", "r", *r, 1, "h") for r in rows], DOCS).repartition(6)
    said = F.replace("text", F.lit("\n"), F.lit(""))
    out = merkle.verified(merkle.documents_manifest(docs, said))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 400, 900])
def test_manifest(spark, n):
    rows = manifest_rows(n, n) if n > 2 else [(i, "a", "de", 1, "t\n") for i in range(n)]
    want = plain_manifest([(*r, None if r[4] is None else r[4].replace("\n", "")) for r in rows]) if rows else []
    got = got_manifest(spark, rows)
    assert [g[:6] for g in got] == want
    assert all(g[6] == (g[5] == g[3]) for g in got)


def test_manifest_of_one_source_in_several_tiers(spark):
    rows = [(i, "only", "de", i, f"text {i}\n") for i in range(merkle.BLOCK * 5 + 2)]
    got = got_manifest(spark, rows)
    assert [g[:6] for g in got] == plain_manifest([(*r, r[4].strip()) for r in rows])
    assert not any(g[6] for g in got)


def test_manifest_of_many_sources(spark):
    rows = [(i, f"s{i % 300}", "de", i, "t") for i in range(700)]
    got = got_manifest(spark, rows)
    assert [g[:6] for g in got] == plain_manifest([(*r, r[4]) for r in rows])
    assert all(g[6] for g in got)


def test_tampered_rows_are_those_with_an_even_checksum(spark):
    got = spark.range(200).select("id", (F.crc32(F.col("id").cast("string")) % 2).alias("odd")).collect()
    assert all(r["odd"] == zlib.crc32(str(r["id"]).encode()) % 2 for r in got)


# --- exact search -----------------------------------------------------------------


def plain_top(rows, every: int, k: int):
    fine = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)[:k]
        out += [(i, rank, j, -score) for rank, (score, j) in enumerate(best, 1)]
    return sorted(out)


def vector_rows(seed: int, n: int, width: int):
    rnd = np.random.default_rng(seed)
    own = np.float32(rnd.standard_normal((n, width)))
    own[n // 2 :: 3] = own[0]  # a large group of copies: many ties
    rows = [(i, own[i].tolist()) for i in range(n)]
    odd = [(None, own[0].tolist()), (n + 1, None), (100 * n, [None] * width), (n + 2, [math.nan] * width), (n + 3, [math.inf] + [0.0] * (width - 1)), (n + 4, [])]
    return rows + odd + rows[:3] + [(n + 5, [0.0] * width)]


def got_top(spark, rows, **more):
    df = spark.createDataFrame([(1, 2, i, v, "q", 3) for i, v in rows], VECTORS).repartition(4)
    return sorted(tuple(r) for r in kdtree.top_k(df, **more).collect())


@pytest.mark.parametrize(("seed", "n", "width", "every", "k"), [(1, 700, 8, 50, 10), (2, 40, 3, 10, 60), (3, 300, 1, 7, 5)])
def test_top_k_is_exact(spark, monkeypatch, seed, n, width, every, k):
    monkeypatch.setattr(kdtree, "QUERY_BLOCK", 8)
    rows = vector_rows(seed, n, width)
    assert got_top(spark, rows, every=every, k=k) == plain_top(rows, every, k)


def test_top_k_of_little(spark):
    assert got_top(spark, []) == []
    assert got_top(spark, [(0, [1.0])]) == []
    assert got_top(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert got_top(spark, [(0, [1.0]), (2, [-1.0])]) == [(0, 1, 2, -(1024**2))]


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_search_in_a_deep_tree(scale):
    """Many leaves, clustered vectors, small and large numbers (the latter as 64-bit integers)."""
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-900, 900, (30, 6))
    x = (centres[rnd.integers(0, 30, 6000)] + rnd.integers(-40, 40, (6000, 6))) * scale
    ids = rnd.permutation(6000)
    order, cuts = kdtree.cut(x)
    state = kdtree.Search(ids[:200], x[:200], np.full(200, kdtree.LEAST + 1), 10)
    state.shard(ids[order], x[order], cuts)
    scores = x[:200] @ x.T
    for q in range(200):
        want = sorted((-s, i) for s, i in zip(scores[q].tolist(), ids.tolist()) if i != ids[q])[:10]
        assert list(zip((-state.scores[q]).tolist(), state.ids[q].tolist())) == want


def test_boxes_save_work_on_clustered_vectors(monkeypatch):
    rnd = np.random.default_rng(6)
    x = rnd.integers(-900, 900, (40, 6))[rnd.integers(0, 40, 8000)] + rnd.integers(-20, 20, (8000, 6))
    order, cuts = kdtree.cut(x)
    state = kdtree.Search(np.arange(50) + 10**6, x[:50], np.full(50, kdtree.LEAST + 1), 10)
    opened = []
    leaf = state._leaf
    monkeypatch.setattr(state, "_leaf", lambda at, scores, ids: (opened.append(scores.size), leaf(at, scores, ids)))
    state.shard(np.arange(8000), x[order], cuts)
    assert sum(opened) < 0.5 * 50 * 8000


# --- whitening --------------------------------------------------------------------


@pytest.mark.parametrize("spectrum", [np.arange(1, 41.0), np.r_[[9.0] * 5, [4.0] * 5, [1e-6] * 10], 10.0 ** -np.arange(12.0), np.ones(7), np.r_[3.0, 1.0, 1.0, 0.0]])
def test_components_match_an_eigensolver(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum),) * 2))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    value, vector = whitening.components(a, 8)
    want = np.sort(spectrum)[::-1][:8]
    assert np.abs(value - want).max() <= 1e-13 * want[0]
    assert np.abs(vector.T @ vector - np.eye(vector.shape[1])).max() <= 1e-13
    assert np.abs(a @ vector - vector * value).max() <= 1e-13 * want[0]


def test_polar_factor_is_the_sign_of_the_eigenvalues():
    rnd = np.random.default_rng(4)
    a = rnd.standard_normal((25, 25))
    a = a + a.T
    value, vector = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (vector * np.sign(value)) @ vector.T).max() < 1e-12


def whitening_rows(n: int, width: int):
    rnd = np.random.default_rng(8)
    x = np.float32(rnd.standard_normal((n, width)) * np.linspace(0.1, 1.5, width))
    rows = [(i, x[i].tolist()) for i in range(n)]
    return rows + [(None, x[0].tolist()), (3, x[3].tolist()), (n, None), (n + 1, [None] * width), (n + 2, [math.nan] * width), (n + 3, [-math.inf] * width)]


@pytest.mark.parametrize(("n", "width"), [(400, 12), (60, 5)])
def test_whitening(spark, n, width):
    rows = whitening_rows(n, width)
    df = spark.createDataFrame([(1, 2, i, v, "q", 3) for i, v in rows], VECTORS).repartition(5)
    got = whitening.whitened(df).toPandas()
    fine = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in fine], dtype=np.int64)
    total, k = len(x), min(8, width)
    assert len(got) == total * k and set(got["n"]) == {total} and sorted(set(got["component"])) == list(range(1, k + 1))
    centred = x - x.sum(axis=0) / total
    value, vector = np.linalg.eigh(centred.T @ centred / total)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    want = centred @ vector / np.sqrt(value)
    far = [sum((total * int(c) - int(s)) ** 2 for c, s in zip(v, x.sum(axis=0))) for _, v in fine]
    for c in range(1, k + 1):
        part = got[got["component"] == c]
        assert sorted(part["deviation"]) == sorted(far)
        own = sorted(part["whitened"])
        assert min(np.abs(np.array(own) - np.sort(s * want[:, c - 1])).max() for s in (1, -1)) < 1e-8
        assert np.allclose(part["explained"], value[c - 1] / np.trace(centred.T @ centred / total), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    by_id = {i: d for (i, _), d in zip(fine, far, strict=True)}
    first = got[(got["component"] == 1) & got["vec_id"].notna()]
    assert all(by_id[int(i)] == d for i, d in zip(first["vec_id"], first["deviation"]))


def test_whitening_of_little(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame([(1, 2, i, v, "q", 3) for i, v in rows], VECTORS)).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [0.5, 0.25])]) == [] and run([(1, [0.5]), (2, [0.5])]) == []
    two = run([(1, [0.5, 1.0]), (2, [0.25, 1.0])])
    assert sorted((r["vec_id"], r["component"], r["n"], abs(round(r["whitened"], 9)), r["explained"]) for r in two) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
