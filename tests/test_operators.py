"""Golden and property tests of the operators on small hand-written rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from amtskompass.operators import catalog, enrich, feeds, jobs, merge, pages, quality, queue, ranking, runs, snapshots, stats, visibility
from amtskompass.operators.related import related
from amtskompass.sources import registry, schemas, tables
from amtskompass.sources.dimensions import dimension

NOW = "2024-07-01 00:00:00"


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


# --- related items: exact against all pairs, with a hot profile ------------------------


def brute_related(items, k):
    out = set()
    for a in items:
        scored = []
        for b in items:
            if a[0] == b[0]:
                continue
            score = 3 * (a[1] == b[1] and a[1] is not None) + 3 * (a[2] == b[2] and a[2] is not None)
            score += 2 * (a[3] == b[3] and a[3] is not None) + bool(set(a[4] or []) & set(b[4] or []))
            if score:
                scored.append((-score, b[5] is None, -(int(b[5].replace("-", "")) if b[5] else 0), b[0]))
        for rank, s in enumerate(sorted(scored)[:k], 1):
            out.add((a[0], s[3], -s[0], rank))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_related_is_exact(spark, seed):
    rng = random.Random(seed)
    items = []
    for i in range(90):
        hot = i % 3 == 0  # a third of all rows share every attribute
        items.append((
            f"{i:03d}", "R0" if hot else rng.choice(["R0", "R1", "R2", None]), "C0" if hot else rng.choice(["C0", "C1", "C2"]),
            "P0" if hot else rng.choice(["P0", "P1", None]), ["g0"] if hot else rng.choice([[], None, ["g0"], ["g1", "g0", "g1"], ["g2"]]),
            rng.choice([None, "2024-01-01", "2024-01-02", "2024-03-05"]),
        ))
    df = spark.createDataFrame(
        items, "id string, region_name string, category string, publisher string, target_groups array<string>, d string"
    ).withColumn("published_at", F.col("d").cast("date"))
    got = {tuple(r) for r in related(df, 3).select("id", "related_id", "score", "rank").collect()}
    assert got == brute_related(items, 3)


# --- ranking -----------------------------------------------------------------------------


def test_global_rank_and_running_total(spark):
    values = list(range(500))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "k int, cost int")
    assert rows(ranking.global_rank(df, [F.col("k")], "r"), "k", "r") == sorted([(v, v + 1) for v in values], key=repr)
    sums = dict(zip(range(500), itertools.accumulate(v % 7 for v in range(500))))
    assert rows(ranking.running_total(df, [F.col("k")], "cost", "s"), "k", "s") == sorted([(v, sums[v]) for v in values], key=repr)


def test_budget_admits_until_reached(spark):
    df = spark.createDataFrame([(0, i, 2) for i in range(5)] + [(1, i, 1) for i in range(5)], "source_idx int, pos int, cost int")
    admitted = ranking.admit_by_budget(df, 11)
    assert admitted.where("admitted").count() == 6  # 5 x 2, then one more while 10 < 11
    assert tuple(ranking.budget_summary(admitted).first()) == (6, 11, 1)


def test_make_batches(spark):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(7)], "refnr string")
    got = ranking.make_batches(df, [F.col("refnr")], 3, F.concat(F.col("slot").cast("string"), F.lit(":"), F.col("refnr")))
    assert rows(got, "batch", "prompt") == [(0, "1:00\n\n2:01\n\n3:02"), (1, "1:03\n\n2:04\n\n3:05"), (2, "1:06")]


# --- merges ------------------------------------------------------------------------------


@pytest.fixture()
def target(spark):
    return spark.createDataFrame(
        [("a", "A", 5, "2024-01-01 00:00:00"), ("b", "B", 6, "2024-01-01 00:00:00")], "id string, title string, view_count int, u string"
    ).withColumn("updated_at", F.col("u").cast("timestamp")).drop("u")


def test_upsert_keeps_and_defaults(spark, target):
    updates = spark.createDataFrame([("b", "B2"), ("c", "C2")], "id string, title string")
    out = merge.upsert(target, updates, "id", NOW)
    assert rows(out, "id", "title", "view_count") == [("a", "A", 5), ("b", "B2", 6), ("c", "C2", 0)]
    again = merge.upsert(out, updates, "id", NOW)
    assert rows(again, *out.columns) == rows(out, *out.columns)


def test_upsert_preserve(spark, target):
    updates = spark.createDataFrame([("b", "B2"), ("c", "C2")], "id string, title string")
    assert rows(merge.upsert(target, updates, "id", NOW, preserve=("title",)), "id", "title") == [("a", "A"), ("b", "B"), ("c", "C2")]


def test_upsert_rejects_duplicate_keys(spark, target):
    updates = spark.createDataFrame([("c", "1"), ("c", "2")], "id string, title string")
    with pytest.raises(Exception, match="duplicate key"):
        merge.upsert(target, updates, "id", NOW).collect()


def test_bulk_status_checks(spark):
    df = spark.createDataFrame([("1", "draft"), ("2", "draft")], "id string, status string")
    assert rows(merge.bulk_status(df, ["2", "9"], "published"), "id", "status") == [("2", "published")]
    for ids, status in ([[], "draft"], [["1"], "bogus"], [[str(i) for i in range(501)], "draft"]):
        with pytest.raises(ValueError):
            merge.bulk_status(df, ids, status)


def test_mutate(spark, target):
    changes = spark.createDataFrame(
        [("a", "A2", "update"), ("b", None, "delete"), ("z", "Z", "insert"), ("q", "Q", "update")], "id string, title string, change string"
    )
    assert rows(merge.mutate(target, changes, NOW), "id", "title") == [("a", "A2"), ("z", "Z")]


def job_rows(spark, data):
    df = spark.createDataFrame(data, "refnr string, is_active boolean, description_de string, description_zh string, title_zh string")
    have = {f.name for f in df.schema}
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.JOB])


def test_delist_empty_fetch(spark):
    base = job_rows(spark, [("1", True, None, None, None), ("2", False, None, None, None)])
    empty = spark.createDataFrame([], "refnr string")
    assert rows(merge.delist_missing(base, empty, NOW), "refnr", "is_active") == [("1", False), ("2", False)]
    assert rows(merge.delist_missing(base, empty, NOW, min_fetched=1), "refnr", "is_active") == [("1", True), ("2", False)]


def test_activation_gate_boundaries_and_idempotence(spark):
    base = job_rows(spark, [
        ("a", True, "x" * 20, "z", "t"), ("b", False, "x" * 21, "z", "t"), ("c", True, "x" * 21, "", "t"), ("d", True, None, "z", "t"),
        ("e", False, "x", "", ""),
    ])
    out = enrich.activation(base)
    assert rows(out, "refnr", "is_active") == [("a", False), ("b", True), ("c", False), ("d", False), ("e", False)]
    assert rows(enrich.activation(out), "refnr", "is_active") == rows(out, "refnr", "is_active")
    assert ("e", True) in rows(enrich.activation(base, "null_only"), "refnr", "is_active")
    gone = spark.createDataFrame([("b",)], "refnr string")
    assert ("b", False) in rows(enrich.activation(base, delisted=gone), "refnr", "is_active")


def hits(spark, data):
    """Hits ``(keyword, kw_ord, page, pos, refnr, title)``."""
    df = spark.createDataFrame(data, "keyword string, kw_ord int, page int, pos int, r string, t string")
    item = F.struct(*[
        {"refnr": F.col("r"), "titel": F.col("t")}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.JOB_HIT_ITEM
    ])
    return df.select("keyword", "kw_ord", "page", "pos", item.alias("item"))


def test_merge_hits_first_wins_and_keywords_collect(spark):
    got = jobs.merge_job_hits(hits(spark, [("B", 1, 1, 0, "x", "late"), ("A", 0, 2, 3, "x", "first"), ("A", 0, 2, 4, "", "none")]))
    row = got.first()
    assert got.count() == 1 and (row["item"]["titel"], row["keywords"]) == ("first", ["A", "B"])


def test_merge_of_normalised_hits_sends_only_what_is_read(spark):
    data = [("B", 1, 1, 0, "x", "late"), ("A", 0, 2, 3, "x", "first"), ("A", 0, 3, 3, "x", "again"), (None, 0, 1, 1, "y", None), ("A", 0, 2, 4, "", "none")]
    merged = jobs.merge_job_hits(jobs.normalize_jobs(hits(spark, data), NOW)).select("refnr", "title_de", "keywords")
    assert rows(merged, "refnr", "title_de", "keywords") == [("x", "first", ["A", "B"]), ("y", "", [])]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "arbeitgeber" not in plan.split("Sort [")[0] and "employer" not in plan


def test_sync_overwrites_tags_unless_preserved(spark):
    base = job_rows(spark, [("x", True, "d", "z", "t"), ("y", True, None, None, None)])
    base = base.withColumns({"tags": F.array(F.lit("T")), "translated": F.lit(True)})
    h = hits(spark, [("A", 0, 1, 0, "x", "neu"), ("A", 0, 1, 1, "n", "N")])
    assert rows(jobs.sync_jobs(base, h, NOW), "refnr", "is_active", "tags", "translated") == [
        ("n", True, [], False), ("x", True, [], False), ("y", False, ["T"], True)]
    kept = jobs.sync_jobs(base, h, NOW, defer=True, preserve=("tags", "translated"))
    assert rows(kept, "refnr", "is_active", "tags", "translated") == [("n", False, [], False), ("x", True, ["T"], True), ("y", False, ["T"], True)]


# --- listings ----------------------------------------------------------------------------


def test_pages_concatenate_to_the_full_order(spark):
    df = spark.createDataFrame([(str(i), i % 5) for i in range(47)], "id string, view_count int")
    order = catalog.page_order("view_count")
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    parts = [r["id"] for p in range(1, 6) for r in catalog.paginate(df, order, p, 10).collect()]
    assert parts == whole
    assert catalog.paginate(df, order, 9, 10).count() == 0
    assert tuple(catalog.page_summary(df, 9, 10).first())[:2] == (47, 9)
    assert len(catalog.paginate(df, order, -1, 0).collect()) == 20


def test_literal_and_wildcard_terms(spark):
    df = spark.createDataFrame([("100%",), ("100 Euro",)], "title string")
    assert df.where(catalog.any_ilike(["title"], "0%0")).count() == 2 - 1 + 1
    assert rows(df.where(catalog.any_ilike(["title"], "0%", literal=True)), "title") == [("100%",)]


def test_search_result_without_query(spark):
    df = spark.createDataFrame([tuple(["x"] * 10)], ", ".join(f"{c} string" for c in visibility.SEARCH_RESULT))
    assert visibility.search_result(df, "").count() == 0 and visibility.search_result(df, "q").count() == 1


def test_facets_keep_first_seen_order(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "b"])], "n int, tags array<string>")
    assert [r["value"] for r in catalog.facets(df, F.col("tags"), ["n"]).collect()] == ["b", "a", "c"]


def test_region_tree_sorts_like_german(spark):
    data = [("Stuttgart", "市"), ("Landkreis Ludwigsburg", "Landkreis"), ("Bayern", "州"), ("Zwickau", "市"), ("联邦", "联邦")]
    got = stats.region_tree(spark.createDataFrame(data, "region_name string, region_level string"))
    assert rows(got, "state", "state_order", "cities") == [
        ("Baden-Württemberg", 0, ["Landkreis Ludwigsburg", "Stuttgart"]), ("Bayern", 1, []), ("Zwickau", 999, [])]


def test_sinks_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("1", "p", "ok", 0.5)], "id string, policy_id string, review_status string, confidence double")
    path = str(tmp_path / "reviews")
    tables.append(df, path, schemas.REVIEW)
    tables.append(df, path, schemas.REVIEW)
    assert tables.read_table(spark, path, schemas.REVIEW, ["id", "confidence"]).count() == 2
    out = str(tmp_path / "json")
    tables.write_json(df, out)
    tables.write_json(df, out)
    assert rows(spark.read.schema(df.schema).json(out), "id", "confidence") == [("1", 0.5)]
    (tmp_path / "reg.json").write_text(
        '[{"id": "a", "name": "Amt A", "feedUrl": "u"}, {"id": "b", "feedUrl": "u", "enabled": false}, {"id": "c", "feedUrl": ""}]'
    )
    reg = registry.read_registry(spark, str(tmp_path / "reg.json"))
    assert rows(registry.active_sources(reg), "id") == [("a",)]
    assert rows(registry.active_sources(reg, "amt a"), "id") == [("a",)] and registry.active_sources(reg, "zzz").count() == 0


def test_city_guides_from_the_fixed_dimension(spark):
    out = {r["region_name"]: r for r in pages.city_fee_guides(dimension(spark, "city_fees")).collect()}
    assert len(out) == 10 and out["Düsseldorf"]["slug"].startswith("hundesteuer-d-sseldorf-")
    assert out["Berlin"]["fees_zh"].split("\n")[:2] == ["首犬：€120/年", "额外犬只（第二只起）：€180/年"]
    assert out["Leipzig"]["tags"] == ["犬税", "Hundesteuer", "Leipzig", "宠物登记", "养犬义务", "市政税务"]


def test_state_codes_join(spark):
    df = job_rows(spark, [("1", True, None, None, None)]).withColumn("state_code", F.lit("Hessen"))
    assert rows(jobs.with_state_code(df, dimension(spark, "states")), "refnr", "code") == [("1", "HE")]


def test_checkpoint_folder_comes_from_the_session(spark):
    from amtskompass.session import reliable_checkpoint

    assert reliable_checkpoint(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir() is not None


# --- pages and feeds -----------------------------------------------------------------------

PAGE = """<html><head><title>Amt - Seite | X</title><script>var a='<p>no</p>'</script></head><body>
<nav><li>Menü Punkt lang genug</li></nav>
<main id="content" class="wide"><h1><span>Haupttitel</span><span>Unter</span></h1>
<div class="c-meta"><p>Meta Angabe zur Seite</p></div>
<div class="column"><h2>Überschrift eins</h2><p>Erster <b>Absatz</b> mit Text.</p><ul><li>Punkt <p>innen</p></li></ul><p>kurz</p><p>Source: weg</p>
<p>Gebühren: 50,5 Euro pro Antrag</p><p>Dauer: 3 Wochen etwa</p></div></main>
<footer><p>Impressum und mehr Text</p></footer></body></html>"""


@pytest.fixture(scope="session")
def page(spark):
    return spark.createDataFrame([("https://a.b/c", PAGE)], "url string, html string")


def test_structured_extraction(page):
    row = pages.extract_guides(page, pages.MIGRATION_OFFICE).first()
    assert row["title_de"] == "Haupttitel"
    assert row["summary_zh"].split("\n\n") == [
        "Überschrift eins", "Erster Absatz mit Text.", "Punkt innen", "innen", "Gebühren: 50,5 Euro pro Antrag", "Dauer: 3 Wochen etwa"]
    assert row["service_key"] == "bamf_a_b_c"


def test_structured_extraction_without_root(spark):
    df = spark.createDataFrame([("u", "<body><p>nothing</p></body>")], "url string, html string")
    assert pages.extract_guides(df, pages.MIGRATION_OFFICE).count() == 0
    short = spark.createDataFrame([("u", "<main><p>zu kurz</p></main>")], "url string, html string")
    assert pages.extract_guides(short, pages.FOREIGN_OFFICE).count() == 0


def test_whole_text_when_parts_are_few(spark):
    df = spark.createDataFrame([("u", "<main><h1>T</h1><div>" + "Wort " * 80 + "</div></main>")], "url string, html string")
    row = pages.extract_guides(df, pages.CONSUMER_GUIDE).first()
    assert row["summary_zh"].startswith("TWort Wort")  # text nodes are joined by nothing


def test_exchange_page(spark):
    html = ("<body><h1>Cookie Hinweis</h1><main><aside>Cookie Wahl</aside><h1>Studium</h1><p>" + "Inhalt zum Studi­um. " * 5
            + "</p><p>Impressum</p></main></body>")
    row = pages.extract_exchange_pages(spark.createDataFrame([("https://d.e/x/", html)], "url string, html string")).first()
    assert row["title_de"] == "Studium"
    assert "Cookie" not in row["summary_zh"] and "Impressum" not in row["summary_zh"] and "Studium." in row["summary_zh"]


def test_office_page(page):
    row = pages.office_page(page, pages.OfficeConfig()).first()
    assert row["fees_zh"] == "Gebühren: 50,5 Euro pro Antrag"
    assert row["duration_zh"] == "Dauer: 3 Wochen etwa"
    assert row["title_de"] == "Berlin LEA — HaupttitelUnter"


def test_basic_page_rules(spark):
    def parse(html):
        return pages.basic_page(spark.createDataFrame([(html,)], "html string")).first()

    p49, p50 = "x" * 49, "x" * 50
    row = parse(f"<title>Ein-Wort Titel</title><p>{p49}</p><p>{p50}</p><p>{p50} <b>x</b></p><p>{p50} Cookie</p> 22.04.2026")
    assert (row["title"], row["content"], row["published_date"]) == ("Ein", p50, "22.04.2026")
    assert parse("<title>T</title><h1>Kopf</h1>")["title"] == "Kopf"
    assert parse("<title>T</title><h1>Kopf <b>x</b></h1>")["title"] == "T"


def test_readable_text(spark):
    df = spark.createDataFrame([("<nav>x</nav><p>a &amp;lt; b</p><script>1</script>\n<style>s</style>c",)], "html string")
    assert pages.readable_text(df).first()["text"] == "a < b c"


def test_links(spark):
    df = spark.createDataFrame([("https://a.b/c/", '<a href="#x">n</a><a href="d" title="T"> D </a><a>none</a><a href="d">again</a>')], "url string, html string")
    links = pages.page_links(df)
    assert rows(links, "link_url", "link_text", "link_title") == [("https://a.b/c/d", "D", "T"), ("https://a.b/c/d", "again", "again")]
    assert rows(pages.distinct_links(links, "url"), "link_url", "link_text") == [("https://a.b/c/d", "D")]


def test_atom_feed_and_missing_fields(spark):
    body = ('<feed><entry><title>A &amp; B</title><link href="https://x/1"/><summary><![CDATA[<i>s</i>]]></summary><updated>2026-04-22T01:00:00Z</updated></entry>'
            "<entry><title></title></entry></feed>")
    got = feeds.parse_feed(spark.createDataFrame([("s", body)], "source_id string, body string")).orderBy("pos").collect()
    assert [tuple(r[c] for c in ("title", "link", "description", "published_at")) for r in got] == [
        ("A & B", "https://x/1", " s ", "2026-04-22"), ("", "", "", "")]


def test_relevance(one):
    rel = feeds.policy_relevant(F.col("a"), F.lit("Neue Gebühr"))
    assert one({"a": "Antrag"}, rel) is True
    assert one({"a": "Besuch"}, rel) is False
    assert one({"a": "x"}, feeds.policy_relevant(F.col("a"), F.lit("y"))) is False


# --- snapshots, queue, runs, quality ---------------------------------------------------------


def test_diff_of_equal_snapshots_is_all_skipped(spark):
    body = "<p>" + "w" * 60 + "</p>"
    new = snapshots.classify_fetch(spark.createDataFrame([("k", "u", 200, "e", body, None)], "service_key string, url string, status int, etag string, body string, error string"))
    first = snapshots.diff_pages(spark.createDataFrame([], "service_key string, content_hash string"), new, NOW)
    assert rows(first, "action") == [("inserted",)]
    old = first.select("service_key", F.col("new_hash").alias("content_hash"))
    assert rows(snapshots.diff_pages(old, new, NOW), "action") == [("skipped",)]
    item = snapshots.enqueue_changes(first, NOW).first()
    assert (item["source_id"], item["priority"]) == (first.first()["target_id"], 0)


def test_claim_counts_each_items_own_attempt(spark):
    data = [("a", 1, 2, "pending"), ("b", 1, 0, "pending"), ("c", 0, 0, "pending"), ("d", 9, 0, "done")]
    df = spark.createDataFrame(data, "id string, priority int, attempts int, status string").withColumn("created_at", F.lit(NOW).cast("timestamp"))
    assert rows(queue.claim(df, 2), "id", "status", "attempts") == [("a", "processing", 3), ("b", "processing", 1), ("c", "pending", 0), ("d", "done", 0)]


def test_retry_plan(spark):
    data = [(1, "a", 1, False), (1, "b", 1, True), (2, "c", 2, False), (3, "d", 2, False), (3, "e", 2, True), (4, "f", 3, False)]
    got = queue.retry_plan(spark.createDataFrame(data, "batch_id int, key string, round int, ok boolean"))
    assert rows(got, "key", "step", "text_cap") == [
        ("a", "retry_batch", 3000), ("b", "done", None), ("c", "retry_single", 1500), ("d", "failed", None), ("e", "done", None), ("f", "failed", None)]


def test_resume_decisions(spark):
    def decide(status, mode, resume_at, **kw):
        df = spark.createDataFrame([("r", mode, status, 4, 9, NOW, resume_at)], "run_id string, mode string, status string, source_index int, request_used int, u string, n string")
        df = df.withColumns({"updated_at": F.col("u").cast("timestamp"), "next_resume_at": F.col("n").cast("timestamp")})
        row = runs.resume_point(df, "recent", "2024-07-01 06:00:00", **kw).first()
        return row["decision"], row["source_index"]

    assert decide("paused", "recent", "2024-07-01 07:00:00") == ("stay_paused", 4)
    assert decide("paused", "recent", "2024-07-01 05:00:00") == ("continue", 4)
    assert decide("paused", "backfill", "2024-07-01 05:00:00") == ("new_run", 0)
    assert decide("completed", "recent", None) == ("new_run", 0)
    assert decide("paused", "recent", "2024-07-01 07:00:00", force=True) == ("new_run", 0)
    none = spark.createDataFrame([], "run_id string, mode string, status string, source_index int, request_used int, updated_at timestamp, next_resume_at timestamp")
    assert runs.resume_point(none, "recent", NOW).first()["decision"] == "new_run"


def test_audit_counts_duplicates(spark):
    df = spark.createDataFrame([("a", "policy", "pending", "1"), ("a", "x", "odd", None)], "id string, source_type string, status string, source_id string")
    assert dict(rows(quality.audit(df, "queue"), "rule", "violations")) == {"type_enum": 1, "status_enum": 1, "source_null": 1, "id_unique": 1}


def test_last_reply_wins_and_missing_field_fails(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "refnr string")
    reps = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", None, 0)], "refnr string, description_zh string, pos int")
    got = enrich.reconcile(batch, reps, "refnr", "description_zh", ["pos"])
    assert rows(got, "refnr", "ok", "r_description_zh") == [("a", True, "2"), ("b", False, None), ("c", False, None)]


# --- page tokens -------------------------------------------------------------------------------


def test_tokens_grow_with_the_page_however_many_tags_stay_open():
    from amtskompass.functions.html import _parse

    def size(page):
        return sum(4 * len(t["at"]) + 40 for t in page["tokens"]) + sum(map(len, page["texts"])) + 8 * len(page["roots"])

    for piece in ("<p>some text ", "<li>item ", "<td>cell ", "<span>word ", "<a href='/x'>link ", "<div class='box'>text ", "<b>bold ", "</i>x<p>"):
        small, large = (size(_parse(piece * (n // len(piece)))) for n in (100_000, 1_000_000))
        assert large < 12 * small and large < 3_000_000_000 and small > 0, piece
    plain = _parse("<p>some text " * 80_000)
    assert size(plain) < 20_000_000 and all(t["end"] - t["begin"] == 1 for t in plain["tokens"])


def test_structure_counts_at_any_depth(spark):
    """Navigation below 400 elements is still navigation, and the main element above them is still the root."""
    deep = "".join(f"<div class='d{i}'>" for i in range(400))
    html = f"<body><nav>weg</nav><main><h1>T</h1>{deep}<nav><ul><li>Navigation ganz unten</li></ul></nav><p>Inhalt ganz unten</p>{'</div>' * 400}</main><p>ausserhalb</p></body>"
    page = spark.createDataFrame([("https://x.de/a", html)], "url string, html string")
    cfg = pages.GuideConfig(prefix="x", root=["main"], title_within=["main"], min_parts=1)
    assert pages.extract_guides(page, cfg).first()["summary_zh"] == "Inhalt ganz unten"
    assert pages.office_page(page.withColumn("html", F.replace("html", F.lit("unten"), F.lit("unten 3 Wochen"))), pages.OfficeConfig()).first()["duration_zh"] == "Inhalt ganz unten 3 Wochen"


def test_marks_of_selectors(spark):
    from amtskompass.functions.html import Selectors, _parse

    selectors = Selectors("main", "#x", ".c", "[r]", odd="div.*y.*")
    html = "<p id=x>a<span class='b c'>b<span>c</span></span><main class=c><div role=r class=my><p>d</main>e"
    tokens = {t["tag"] if t["tag"] != "#text" else page["texts"][t["begin"]]: t for page in [_parse(html, tuple(map(re.compile, selectors.patterns)))] for t in page["tokens"]}
    inside = {k: "".join(n[0] for n, at in zip(selectors.place, t["at"]) if at >= 0) for k, t in tokens.items() if len(k) == 1}
    assert inside == {"p": "m.[o", "a": "#", "b": "#.", "c": "#.", "d": "m.[o", "e": ""}


def test_text_split_by_tags_stays_whole(spark):
    html = "<main><h1>Ein<b>bürger</b>ung</h1><p>Die Ein<i>bürger</i>ung dauert.</p></main>"
    page = spark.createDataFrame([("https://x.de/a", html)], "url string, html string")
    cfg = pages.GuideConfig(prefix="x", root=["main"], title_within=["main"])
    row = pages.extract_guides(page, cfg).first()
    assert row["title_de"] == "Einbürgerung" and row["summary_zh"] == "EinbürgerungDie Einbürgerung dauert."


def test_fee_lines_with_unusual_blanks_and_capitals(one):
    from amtskompass.functions import constants as C

    for line in ("10 € im Amt", "GEBÜHREN", "5,50 EUR", "gebührenpflichtig"):
        assert one({"a": f"nichts\n{line}"}, pages.first_matching_line(F.split("a", "\n"), C.FEE_PATTERNS)) == line
    assert one({"a": "etwa 3 WOCHEN"}, pages.first_matching_line(F.split("a", "\n"), C.DURATION_PATTERNS)) == "etwa 3 WOCHEN"


def test_save_etags_of_shared_and_missing_addresses(spark):
    def tags(*data):
        return spark.createDataFrame(data, "url string, etag string")

    got = snapshots.save_etags(tags(("a", "1"), ("b", "2"), ("c", "3"), ("c", "4"), (None, "5")), tags(("a", "6"), ("a", "7"), ("b", None), ("c", "8"), ("d", "9"), (None, "10"), (None, "11")))
    want = [("a", "6"), ("a", "7"), ("b", "2"), ("c", "8"), ("c", "8"), ("d", "9"), (None, "5"), (None, "10"), (None, "11")]
    assert rows(got, "url", "etag") == sorted(want, key=repr)
