"""The incremental stream gives the same table as folding the batches by hand, replays included."""

import random

import pytest
from pyspark.sql import functions as F

from amtskompass.functions.keys import content_hash
from amtskompass.operators.snapshots import classify_fetch
from amtskompass.sources.schemas import PAGE_STATE, POLICY_PAGE
from amtskompass.streaming import buckets as B
from amtskompass.streaming import incremental as inc
from amtskompass.streaming.latest import latest_clean


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Little data: two state stores and two writers for each batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def landed(spark, data):
    df = spark.createDataFrame(data, "service_key string, url string, etag string, body string, error string, status int, t string")
    return df.withColumn("fetched_at", F.col("t").cast("timestamp")).select(*[f.name for f in inc.LANDED])


def body(word):
    return f"<title>{word}</title><p>{word * 60}</p>"


def test_stream_merges_new_and_changed_pages(spark, tmp_path):
    tables = inc.PageTables(str(tmp_path / "tables"))
    inc.start(spark, tables, spark.createDataFrame([], POLICY_PAGE), spark.createDataFrame([], PAGE_STATE))
    landing, ckpt = str(tmp_path / "landing"), str(tmp_path / "ckpt")

    landed(spark, [
        ("a", "u/a", "e1", body("x"), None, 200, "2024-01-01 00:00:00"), ("b", "u/b", "e1", body("y"), None, 200, "2024-01-01 00:00:00"),
        ("c", "u/c", None, None, "timeout", 0, "2024-01-01 00:00:00"),
    ]).coalesce(1).write.mode("append").parquet(landing)
    inc.run_available(spark, landing, tables, ckpt).awaitTermination()
    first = {r["service_key"]: r for r in inc.read_pages(spark, tables).collect()}
    assert set(first) == {"a", "b"} and first["a"]["title_de"] == "x" and first["a"]["translated"] is False

    landed(spark, [
        ("a", "u/a", "e2", body("z"), None, 200, "2024-01-02 00:00:00"), ("b", "u/b", "e1", None, None, 304, "2024-01-02 00:00:00"),
    ]).coalesce(1).write.mode("append").parquet(landing)
    inc.run_available(spark, landing, tables, ckpt).awaitTermination()
    second = {r["service_key"]: r for r in inc.read_pages(spark, tables).collect()}
    assert second["a"]["content_hash"] != first["a"]["content_hash"]
    assert str(second["a"]["last_fetched_at"]) == "2024-01-02 00:00:00"
    assert second["b"] == first["b"]
    version = inc.last_version(spark, tables)
    state = {r["url"]: r["etag"] for r in inc.read_state(spark, tables).collect()}
    assert state == {"u/a": "e2", "u/b": "e1"}
    work = spark.read.parquet(tables.queue(version)).collect()
    assert [(r["source_id"], r["priority"], str(r["created_at"])) for r in work] == [(second["a"]["id"], 1, "2024-01-02 00:00:00")]

    # a replayed batch gives the same snapshot
    again = spark.read.schema(inc.LANDED).parquet(landing).where("fetched_at >= '2024-01-02'")
    inc.merge_batch(spark, tables, again, version)
    assert {r["service_key"]: r for r in inc.read_pages(spark, tables).collect()} == second


def test_latest_clean_answer_counts_and_empty_pages_get_no_tag(spark, tmp_path):
    tables = inc.PageTables(str(tmp_path / "tables"))
    inc.start(spark, tables, spark.createDataFrame([], POLICY_PAGE), spark.createDataFrame([], PAGE_STATE))
    batch = landed(spark, [
        ("a", "u/a", "e1", body("x"), None, 200, "2024-01-01 00:00:00"), ("a", "u/a", None, None, "timeout", 0, "2024-01-02 00:00:00"),
        ("b", "u/b", "e9", "", None, 200, "2024-01-01 00:00:00"),
    ])
    inc.merge_batch(spark, tables, batch, 0)
    assert [(r["service_key"], str(r["last_fetched_at"])) for r in inc.read_pages(spark, tables).collect()] == [("a", "2024-01-01 00:00:00")]
    assert [(r["url"], r["etag"]) for r in inc.read_state(spark, tables).collect()] == [("u/a", "e1")]


def test_batch_of_one_page_rewrites_one_bucket_and_old_files_go(spark, tmp_path):
    tables = inc.PageTables(str(tmp_path / "tables"), buckets=8)
    inc.start(spark, tables, spark.createDataFrame([], POLICY_PAGE), spark.createDataFrame([], PAGE_STATE))
    many = [(f"k{i}", f"u/{i}", "e", body(f"w{i}"), None, 200, "2024-01-01 00:00:00") for i in range(40)]
    inc.merge_batch(spark, tables, landed(spark, many), 0)
    for version in range(1, 5):
        inc.merge_batch(spark, tables, landed(spark, [("k7", "u/7", f"e{version}", body(f"v{version}"), None, 200, f"2024-02-0{version} 00:00:00")]), version)
        entries = inc.manifest(spark, tables, version)
        assert sum(v == version for (kind, _), v in entries.items() if kind == "pages") == 1
    assert inc.versions(spark, tables) == [2, 3, 4]
    kept = {int(p.parent.name.split("=")[1]) for p in (tmp_path / "tables" / "pages").glob("version=*/bucket=*") if any(p.iterdir())}
    assert kept == {0, 2, 3, 4}
    found = {r["service_key"]: r["title_de"] for r in inc.read_pages(spark, tables).collect()}
    assert len(found) == 40 and found["k7"] == "v4" and found["k8"] == "w8"


def column_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def stream_of(spark, root, files, stored, horizon="30 days"):
    """Pages and tags after a stream that takes the given files one by one."""
    tables = inc.PageTables(f"{root}/tables", buckets=4)
    inc.start(spark, tables, stored, spark.createDataFrame([], PAGE_STATE))
    for i, rows in enumerate(files):
        landed(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        if i + 2 == len(files) or i + 1 == len(files):  # the first run finds several files
            inc.run_available(spark, f"{root}/landing", tables, f"{root}/ckpt", files_per_batch=1, horizon=horizon).awaitTermination()
    return column_rows(inc.read_pages(spark, tables)), column_rows(inc.read_state(spark, tables))


def stored_page(spark, content):
    """A page that was in the table before: translated, enriched."""
    new = spark.createDataFrame([("old", content)], "service_key string, body string")
    hashed = classify_fetch(new.withColumns({"error": F.lit(None).cast("string"), "status": F.lit(200)})).select(content_hash(F.col("content"))).first()[0]
    early = F.lit("2023-12-01 00:00:00").cast("timestamp")
    values = {"id": F.lit("id-old"), "service_key": F.lit("old"), "content_hash": F.lit(hashed), "translated": F.lit(True), "title_zh": F.lit("zh"),
              "fees_zh": F.lit("1 Euro"), "created_at": early, "updated_at": early, "last_fetched_at": early}
    return spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POLICY_PAGE])


FETCHES = [  # a 200 and a later timeout, a change and back, a late clean answer, answers of one time, the stored content again
    ("a", "u/a", "e1", body("x"), None, 200, "2024-01-01 00:00:00"), ("a", "u/a", None, None, "timeout", 0, "2024-01-02 00:00:00"),
    ("b", "u/b", "e1", body("p"), None, 200, "2024-01-01 00:00:00"), ("b", "u/b", "e2", body("q"), None, 200, "2024-01-03 00:00:00"),
    ("b", "u/b", "e3", body("p"), None, 200, "2024-01-05 00:00:00"), ("b", "u/b", None, body("p"), None, 200, "2024-01-06 00:00:00"),
    ("c", "u/c", None, None, None, 304, "2024-01-04 00:00:00"), ("c", "u/c", "e1", body("r"), None, 200, "2024-01-02 00:00:00"),
    ("c", "u/c", "e0", body("s"), None, 200, "2024-01-02 00:00:00"), ("d", "u/d", None, "", None, 200, "2024-01-02 00:00:00"),
    ("old", "u/o", "e5", body("o"), None, 200, "2024-01-05 00:00:00"), ("old", "u/o", "e4", body("n"), None, 200, "2024-01-04 00:00:00"),
    ("old", "u/o", "e3", body("o"), None, 200, "2024-01-03 00:00:00"), (None, "u/x", "e", body("x"), None, 200, "2024-01-03 00:00:00"),
    ("e", "u/e", "e1", body("t"), None, 200, None), ("e", "u/e", "e2", body("u"), None, 200, "2024-01-01 00:00:00"),
]


def test_result_does_not_depend_on_the_order_of_the_files(spark, tmp_path):
    stored = stored_page(spark, body("o"))
    want, tags = stream_of(spark, tmp_path / "one", [FETCHES], stored)
    pages = {r[1]: dict(zip([f.name for f in POLICY_PAGE], r)) for r in want}
    assert set(pages) == {"a", "b", "c", "e", "old"} and dict(tags) == {"u/a": "e1", "u/b": "e3", "u/c": "e0", "u/e": "e2", "u/o": "e5"}
    at = lambda key, name: str(pages[key][name])[:10]
    assert [at("b", c) for c in ("created_at", "updated_at", "last_fetched_at")] == ["2024-01-01", "2024-01-05", "2024-01-06"]
    assert pages["c"]["title_de"] == "s" and pages["e"]["title_de"] == "u"
    # changed and changed back: what was enriched from the old content is gone all the same
    assert pages["old"]["translated"] is False and [at("old", c) for c in ("created_at", "updated_at")] == ["2023-12-01", "2024-01-05"]
    rows = FETCHES * 2  # every fetch is delivered twice
    random.Random(5).shuffle(rows)
    assert stream_of(spark, tmp_path / "order", [rows[i::4] for i in range(4)], stored) == (want, tags)


def test_timer_folds_what_has_passed_the_horizon(spark, tmp_path):
    days = [("a", "u/a", f"e{d}", body("xyz"[d % 3]), None, 200, f"2024-0{1 + d // 28}-{1 + d % 28:02d} 00:00:00") for d in range(0, 60, 20)]
    want = stream_of(spark, tmp_path / "long", [days], stored_page(spark, body("o")))
    late = ("a", "u/a", "late", body("late"), None, 200, "2024-01-02 00:00:00")  # beyond the horizon: dropped
    files = [[d] for d in days] + [[late], [days[-1]]]
    assert stream_of(spark, tmp_path / "short", files, stored_page(spark, body("o")), horizon="3 days") == want


def test_folding_a_table_equals_folding_a_stream(spark):
    rows = landed(spark, FETCHES)
    got = {r["service_key"]: (r["title"], str(r["first_at"]), str(r["changed_at"]), str(r["fetched_at"]), r["etag"]) for r in latest_clean(rows).collect()}
    assert got["b"] == ("p", "2024-01-01 00:00:00", "2024-01-05 00:00:00", "2024-01-06 00:00:00", "e3")
    assert got["e"] == ("u", "None", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "e2")
    assert latest_clean(rows.limit(0)).count() == 0


# --- growing buckets ------------------------------------------------------------------


def test_every_cell_has_one_owner():
    rnd = random.Random(3)
    for _ in range(30):
        base = rnd.choice([1, 3, 5])
        leaves = {B.Bucket(0, v) for v in range(base)}
        for _ in range(rnd.randint(0, 6)):  # split some, forget empty ones
            b = min(rnd.sample(sorted(leaves), min(3, len(leaves))))
            if b.level > 4:
                continue
            leaves.remove(b)
            leaves |= set(B.children(base, b, 10 * rnd.randint(2, 4), 10))
        known = {b for b in leaves if rnd.random() < 0.7}
        inner, top = B.inner_of(base, known), max((b.level for b in leaves), default=0)
        for v in range(base << top):
            own = B.owner(base, known, inner, B.Bucket(top, v))
            assert v % (base << own.level) == own.value
            covering = [b for b in known if v % (base << b.level) == b.value]
            assert covering == [own] if covering else not any(k.level >= own.level and k.value % (base << own.level) == own.value for k in known)


def test_full_buckets_split_and_keep_all_rows(spark, tmp_path):
    tables = inc.PageTables(str(tmp_path / "tables"), buckets=2, split_rows=8)
    inc.start(spark, tables, spark.createDataFrame([], POLICY_PAGE), spark.createDataFrame([], PAGE_STATE))
    known = {}
    for version in range(3):
        keys = range(version * 30, version * 30 + 40)  # some of them again
        batch = [(f"k{i}", f"u/{i}", f"e{version}", body(f"w{version}{i}"), None, 200, f"2024-02-0{version + 1} 00:00:00") for i in keys]
        inc.merge_batch(spark, tables, landed(spark, batch), version)
        known |= {f"k{i}": f"w{version}{i}" for i in keys}
        found = inc.read_pages(spark, tables).select("service_key", "title_de").collect()
        assert sorted(map(tuple, found)) == sorted(known.items())
    entries = inc.entries_of(spark, tables, 2)
    sizes = {b: e.rows for (kind, b), e in entries.items() if kind == "pages"}
    assert sum(sizes.values()) == 100 and max(b.level for b in sizes) >= 2 and len(sizes) > 6
    assert sum(e.rows for (kind, _), e in entries.items() if kind == "state") == 100
    # a whole table begins with as many buckets as it needs
    again = inc.PageTables(str(tmp_path / "again"), buckets=2, split_rows=8)
    inc.start(spark, again, inc.read_pages(spark, tables), inc.read_state(spark, tables))
    assert max(e.rows for e in inc.entries_of(spark, again, -1).values()) < 30
    assert column_rows(inc.read_pages(spark, again)) == column_rows(inc.read_pages(spark, tables))


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60000).select(F.col("id").cast("string").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("etag"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        done = B.write(rows.repartition(8), "url", 1, [B.Bucket(0, 0)], str(tmp_path / "t"), PAGE_STATE, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert done[B.Bucket(0, 0)].rows == 60000
    assert len(list((tmp_path / "t").glob("bucket=*/*.parquet"))) > 3
