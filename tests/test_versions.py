"""Committed versions, shared queues, seek paging, narrow ranks, suggestions, open JSON, references."""

import json
import random

import pytest
from pyspark.sql import functions as F

from amtskompass.operators import catalog, quality, ranking, runs
from amtskompass.operators.claims import QueueTable
from amtskompass.operators.paging import page_index
from amtskompass.operators.queue import next_items
from amtskompass.sources.commits import CommitLog, append_once, publish_json, read_appended, read_published
from amtskompass.sources.schemas import QUEUE


def queue_rows(spark, n):
    rnd = random.Random(n)
    base = spark.createDataFrame([(f"i{i:03d}", rnd.choice([0, 1, 2, None]), rnd.choice(["pending"] * 4 + ["done", "processing"]), i % 3) for i in range(n)], "id string, priority int, status string, attempts int")
    return base.select(*[(F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in QUEUE])


def state(table, version=None):
    return {r["id"]: (r["status"], r["attempts"], r["error_message"]) for r in table.read(version).collect()}


# --- commits ------------------------------------------------------------------------


def test_only_one_of_two_commits_of_a_version_is_accepted(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.latest() == -1 and log.versions() == []
    assert log.commit(0, {"who": "a", "ü": [1]}) and not log.commit(0, {"who": "b"})
    assert log.read(0) == {"who": "a", "ü": [1]} and log.versions() == [0]
    assert log.commit(1, {"who": "b"}) and log.latest() == 1
    assert [p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".json"].__len__() == 2  # nothing is left aside


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"))
    assert read_appended(spark, root, rows.schema).count() == 0
    assert append_once(rows, root, "one") and not append_once(rows, root, "one")
    assert append_once(rows.where("k < 5"), root, "two") and append_once(rows.where("false"), root, "empty")
    assert read_appended(spark, root, rows.schema).count() == 15
    assert read_appended(spark, root, rows.schema, 0).count() == 10


def test_an_append_that_is_overtaken_is_committed_on_top(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = spark.range(3).select("id")
    commit, raced = CommitLog.commit, []

    def slow(self, version, payload):
        if not raced:  # someone else commits between our write and our commit
            raced.append(version)
            append_once(rows.where("id = 0"), root, "other")
        return commit(self, version, payload)

    monkeypatch.setattr(CommitLog, "commit", slow)
    assert append_once(rows, root, "mine")
    assert sorted(r["id"] for r in read_appended(spark, root, rows.schema).collect()) == [0, 0, 1, 2]


def test_a_published_result_is_replaced_as_a_whole(spark, tmp_path):
    rows = spark.range(4).select("id", F.lit("ü\n").alias("t"))
    assert [publish_json(rows, str(tmp_path)), publish_json(rows.where("id > 2"), str(tmp_path))] == [0, 1]
    assert [tuple(r) for r in read_published(spark, str(tmp_path), rows.schema).collect()] == [(3, "ü\n")]


# --- claims -------------------------------------------------------------------------


def test_interleaved_claims_take_different_items(spark, tmp_path):
    rows = queue_rows(spark, 60)
    order = [r["id"] for r in next_items(rows, 60).collect()]
    table = QueueTable.create(rows, str(tmp_path))
    with pytest.raises(ValueError):
        QueueTable.create(rows, str(tmp_path))
    a, b = table.propose_claim(4), table.propose_claim(4)
    assert table.commit(a) and not table.commit(b)  # both picked the same items; the second is refused
    before = state(table)
    second = sorted(r["id"] for r in table.claim(4).collect())  # and repeated
    assert second == sorted(order[4:8]) and [i for i in order[:4] if before[i][0] != "processing"] == []
    now, start = state(table), {r["id"]: r for r in rows.collect()}
    assert {i for i, s in now.items() if s[0] == "processing" and start[i]["status"] == "pending"} == set(order[:8])
    assert all(now[i][1] == start[i]["attempts"] + (i in order[:8]) for i in now)
    assert state(table, 0) == {i: (r["status"], r["attempts"], r["error_message"]) for i, r in start.items()}  # old versions stay readable


def test_settled_items_and_compaction(spark, tmp_path, monkeypatch):
    table = QueueTable.create(queue_rows(spark, 30), str(tmp_path))
    taken = table.claim(3)
    ids = sorted(r["id"] for r in taken.collect())
    outcomes = taken.select("id", (F.col("id") == ids[0]).alias("ok"), F.lit("no").alias("message"))
    claimed = state(table)
    table.settle(outcomes, "2024-01-01 00:00:00")
    now = state(table)
    assert now[ids[0]][0] == "done" and all(now[i] == ("failed" if claimed[i][1] + 1 >= 3 else "pending", claimed[i][1] + 1, "no") for i in ids[1:])
    assert table.compact(most=1) and not table.compact(most=1)
    assert state(table) == now and table.log.read(table.log.latest())["changes"] == []
    while table.claim(20).count():
        pass
    assert "pending" not in {s[0] for s in state(table).values()}


# --- paging and ranks -----------------------------------------------------------------


def test_every_page_equals_offset_paging(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, rnd.choice([None, *range(9)]), "x" * i) for i in range(157)], "id int, v int, t string").repartition(3)
    order = [F.col("v").desc_nulls_first(), F.col("id").asc()]
    index = page_index(rows, order, 12)
    assert index.total == 157 and len([c for c in index.counts if c]) > 5
    for size in (10, 50, 200):
        for page in range(1, 157 // size + 3):
            assert index.page(page, size).collect() == catalog.paginate(rows, order, page, size).collect()
            assert size > 10 or len(index.span((page - 1) * size, size)[0]) <= 3
    assert index.page(None, 0).collect() == catalog.paginate(rows, order, None, 0).collect()
    empty = page_index(rows.limit(0), order, 4)
    assert empty.total == 0 and empty.page(1, 10).count() == 0


def test_a_page_reads_the_files_of_its_partitions_only(spark):
    index = page_index(spark.range(1000).select("id"), [F.col("id").asc()], 10)
    page = index.page(40, 20)
    assert len(page.inputFiles()) <= 2 and [r["id"] for r in page.collect()] == list(range(780, 800))


def test_narrow_ranks_freeze_no_payload(spark, monkeypatch):
    frozen = []
    real = ranking.reliable_checkpoint
    monkeypatch.setattr(ranking, "reliable_checkpoint", lambda df: (frozen.append(df.columns), real(df))[1])
    df = spark.createDataFrame([(i * 7 % 50, "payload", i % 4) for i in range(50)], "k int, t string, cost int")
    ranked = ranking.global_rank(df, [F.col("k").desc()], "r", key=["k"])
    assert sorted((r["k"], r["r"], r["t"]) for r in ranked.collect()) == [(k, 50 - k, "payload") for k in range(50)]
    total = {r["k"]: r["s"] for r in ranking.running_total(df, [F.col("k")], "cost", "s", key=["k"]).collect()}
    costs = {r["k"]: r["cost"] for r in df.collect()}
    assert total == {k: sum(costs[j] for j in range(k + 1)) for k in range(50)}
    assert all("t" not in columns for columns in frozen)


# --- suggestions ------------------------------------------------------------------------


def plain_suggestions(rows, n):
    seen = {}
    for day, i, terms in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        for t in terms:
            if t is not None:
                seen.setdefault(t, i)
    return list(seen.items())[:n]


@pytest.mark.parametrize("distinct", [3, 40])
def test_suggestions_read_the_newest_rows_first(spark, monkeypatch, distinct):
    monkeypatch.setattr(catalog, "READ_AT_FIRST", 1)
    monkeypatch.setattr(catalog, "READ_MOST", 60)
    rnd = random.Random(distinct)
    rows = [(rnd.choice([None, *range(20)]), f"i{i:03d}", f"cat{rnd.randrange(distinct)}", rnd.choice([None, "r1", "r2"]), [f"g{rnd.randrange(distinct)}"]) for i in range(200)]
    df = spark.createDataFrame(rows, "d int, id string, category string, region_name string, target_groups array<string>")
    df = df.withColumn("published_at", F.when(F.col("d").isNotNull(), F.date_add(F.lit("2024-01-01").cast("date"), "d"))).withColumn("title_de", F.lit("kurz langes"))
    want = plain_suggestions([(d, i, [c, r, *g, "langes"]) for d, i, c, r, g in rows], 12)
    prepared = []
    got = catalog.suggestions(df, 12, lambda part: (prepared.append(1), part)[1]).collect()
    assert [(r["term"], r["first_id"]) for r in got if r["term"] is not None] == want[: len([r for r in got if r["term"] is not None])]
    assert len(got) >= min(12, len(want)) and prepared


# --- open JSON and references --------------------------------------------------------------


def test_unknown_keys_survive_a_round_trip(spark, tmp_path):
    texts = ['{"mode":"recent","requestUsed":7,"totals":{"new":[1,{"x":null}]},"later":{"ü":1.5}}', '{"requestUsed":"many"}', "[1,2]", "no json", None, "{}"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "run_id string, checkpoint string")
    runs.open_checkpoints(df).select("run_id", "state").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    back = {r["run_id"]: r["t"] for r in stored.select("run_id", runs.checkpoint_json().alias("t")).collect()}
    assert [json.loads(back[k]) if back[k] else None for k in sorted(back)] == [json.loads(texts[0]), json.loads(texts[1]), [1, 2], None, None, {}]
    rows = {r["run_id"]: r for r in runs.open_checkpoints(df).collect()}
    assert (rows["0"]["cp_mode"], rows["0"]["cp_request_used"], rows["1"]["cp_request_used"], rows["2"]["cp_mode"]) == ("recent", 7, None, None)
    keys = {(r["run_id"], r["name"]): r["type"] for r in runs.checkpoint_keys(stored).collect()}
    assert keys["0", "mode"] == "STRING" and keys["1", "requestUsed"] == "STRING" and ("3", "mode") not in keys


def test_dangling_references(spark):
    reviews = spark.createDataFrame([("r1", "p1"), ("r2", "p9"), ("r3", None), ("r0", "p9"), ("r4", "p8")], "id string, policy_id string")
    pages = spark.createDataFrame([("p1",), ("p2",)], "id string")
    row = quality.audit_references(reviews, pages, samples=2).first()
    assert (row["rule"], row["violations"], row["samples"]) == ("policy_id_in_policy", 3, ["r0", "r2"])
    assert {r["target"]: r["violations"] for r in quality.reference_summary(reviews, pages).collect()} == {"p9": 2, "p8": 1}
    assert quality.audit_references(reviews.limit(0), pages).first()["violations"] == 0
