"""The path-template tree against the same rules in plain Python, level by level."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from amtskompass.llm import urls


def looks_variable(segment: str) -> bool:
    bare = re.sub(r"\.[A-Za-z]{1,5}\Z", "", segment)
    return bool(
        re.match(r"\A[0-9]+\Z", bare) or re.match(r"\A[0-9]{4}[-_.][0-9]{1,2}([-_.][0-9]{1,2})?\Z", bare) or re.match(r"(?i)\A(?=.*[0-9])[0-9a-f-]{8,}\Z", bare)
        or re.match(r"(?i)\A(?=.*[0-9].*[0-9])[0-9a-z_-]{12,}\Z", bare) or len(bare) > 40
    )


def plain_tree(pages, labels):
    """page_id -> (template, rejected) of pages (id, host, path), with labels (id, bad)."""
    marks = collections.defaultdict(list)
    for i, bad in labels:
        marks[i].append(bad)
    paths = collections.defaultdict(lambda: [0, 0, 0])
    for i, host, path in pages:
        row = paths[host, path]
        row[0], row[1], row[2] = row[0] + 1, row[1] + len(marks[i]), row[2] + sum(marks[i])
    segments = {k: [s for s in k[1].split("/") if s] for k in paths}
    template = {k: "" for k in paths}
    for level in range(max(map(len, segments.values()), default=0)):
        place = collections.defaultdict(collections.Counter)
        for k, own in segments.items():
            if len(own) > level and not looks_variable(own[level]):
                place[k[0], template[k]][own[level]] += paths[k][0]
        wild = {p for p, c in place.items() if len(c) >= urls.MANY and len(c) >= urls.VARIED * sum(c.values())}
        for k, own in segments.items():
            if len(own) > level:
                step = "*" if looks_variable(own[level]) or (k[0], template[k]) in wild else own[level]
                template[k] = f"{template[k]}/{step}"
    leaves = collections.defaultdict(lambda: [0, 0])
    for k, t in template.items():
        leaves[k[0], t][0] += paths[k][1]
        leaves[k[0], t][1] += paths[k][2]
    merged = {k: k[1] for k in leaves}
    for level in range(max((t.count("/") for _, t in leaves), default=0), 0, -1):
        branches, family = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [set(), 0, 0])
        for k, (n, bad) in leaves.items():
            branches[k[0], merged[k]][0] += n
            branches[k[0], merged[k]][1] += bad
        key = lambda host, t: (host, tuple(t.split("/")[:level]), tuple(t.split("/")[level + 1 :]))  # noqa: E731, B023
        for (host, t), (n, bad) in branches.items():
            if t.count("/") >= level:
                row = family[key(host, t)]
                row[0].add(t)
                row[1], row[2] = row[1] + n, row[2] + bad
        for k, t in list(merged.items()):
            if t.count("/") < level or len(family[key(k[0], t)][0]) < 2:
                continue
            _, all_n, all_bad = family[key(k[0], t)]
            n, bad = branches[k[0], t]
            share = all_bad / all_n if all_n else 0
            if n == 0 or abs(bad / n - share) < urls.Z * math.sqrt(max(share * (1 - share), 1e-4) / n):
                steps = t.split("/")
                merged[k] = "/".join([*steps[:level], "*", *steps[level + 1 :]])
    n, bad = sum(x[0] for x in leaves.values()), sum(x[1] for x in leaves.values())
    prior = (bad + 1) / (n + 2) if n else 0
    pure = collections.defaultdict(lambda: [0, 0])
    for k, (a, b) in leaves.items():
        pure[k[0], merged[k]][0] += a
        pure[k[0], merged[k]][1] += b
    out = {}
    for i, host, path in pages:
        m = merged[host, template[host, path]]
        a, b = pure[host, m]
        out[i] = (m, (b + urls.PRIOR_PAGES * prior) / (a + urls.PRIOR_PAGES) >= urls.THRESHOLD)
    return out


def judged(spark, pages, labels):
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in pages], "page_id long, url string").repartition(4)
    found = urls.filtered(df, spark.createDataFrame(labels, "page_id long, bad int"), rules=())
    return {r["page_id"]: (r["template"], r["verdict"] == "block") for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_plain_python(spark, seed):
    rnd = random.Random(seed)
    words = ["shop", "news", "blog", "cat", "item", "a.html", "2024", "x" * 45, "de", "en"] + [f"n{i}" for i in range(30)]
    pages = [(i, rnd.choice(["h.com", "k.com"]), "".join("/" + rnd.choice(words[: rnd.choice([4, 10, 40])]) for _ in range(rnd.choice([0, 1, 2, 2, 3, 3, 5])))) for i in range(400)]
    labels = [(i, int("shop" in p or rnd.random() < 0.2)) for i, _, p in pages if rnd.random() < 0.5] + [(3, 1)]
    assert judged(spark, pages, labels) == plain_tree(pages, labels)


def test_siblings_below_the_first_level_are_judged_together(spark):
    """Nineteen sections below one parent, one bad page each: alone none of them would be rejected."""
    pages = [(i, "h.com", f"/shop/cat{chr(97 + i)}/{i}") for i in range(19)] + [(100 + i, "h.com", f"/news/{i}") for i in range(60)] + [(200, "h.com", "/shop/catz/7")]
    labels = [(i, 1) for i in range(19)] + [(100 + i, 0) for i in range(60)]
    got = judged(spark, pages, labels)
    assert got == plain_tree(pages, labels)
    assert all(got[i] == ("/shop/*/*", True) for i in [*range(19), 200]) and not any(got[100 + i][1] for i in range(60))


def test_paths_are_told_apart_at_any_depth(spark):
    """Good and bad sections that differ in their tenth segment only."""
    deep = "/a/b/c/d/e/f/g/h/i"
    pages = [(i, "h.com", f"{deep}/{'good' if i % 2 else 'bad'}/{i}") for i in range(60)]
    labels = [(i, 1 - i % 2) for i in range(50)]
    got = judged(spark, pages, labels)
    assert got == plain_tree(pages, labels)
    assert all(got[i] == (f"{deep}/{'good' if i % 2 else 'bad'}/*", i % 2 == 0) for i in range(60))
