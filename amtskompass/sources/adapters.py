"""Role tables derived from the generic star-schema, event, document, page and chat tables.

The adapters give every operator realistic input that grows with the given tables.  Label
and phrase lists only spread values over rows; no row is filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# phrases that exercise the keyword rules, including disclaimers that must not count
PHRASES = [
    "Antrag auf Einbürgerung", "Aufenthalt und 签证", "蓝卡 Blue Card", "学校 und Kita", "Krankenversicherung",
    "家庭 Familien", "Steuer und Gebühr", "Führerschein", "Hund und 犬税", "预约 Verwaltung",
    "不涉及个人居留与税务的专业建议。", "Allgemeines", "不构成法律建议", "Bewerbung bei Arbeitslosigkeit",
]
REGIONS = [
    "Stuttgart", "baden w", "Deutschland", "Bundesland X", "Berlin", "Mannheim", "Ludwigsburg", "bayern", "Hessen",
    "schleswig holstein", "Ulm",
]
LEVELS = ["联邦", "州", "市", "Landkreis", "bogus"]
STATUSES = ["draft", "expired", "unpublished", "published", "published", "published", "published"]
RISKS = ["low", "medium", "high"]
JOB_PHRASES = [
    "Werkstudent in der Informatik", "Pflege im Krankenhaus", "Koch im Hotel", "Fahrer fuer Lager und Logistik",
    "Buchhaltung in Vollzeit", "Verkauf in Teilzeit", "Software mit Python und SQL, Homeoffice", "Reinigung, Minijob",
    "Chinesisch und Englisch von Vorteil", "Ingenieur ohne Berufserfahrung", "Kundenservice und Verwaltung",
]


SCAN_PARTITIONS = "spark.amtskompass.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a given table.

    A file with one row group is one task, however many cores there are.  A session that reads such files can set
    ``SCAN_PARTITIONS`` to deal their rows to that many tasks; where it is unset, as on a cluster, nothing is shuffled.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(tasks)) if tasks else rows


def pick(values: list[str], index: Column) -> Column:
    """Member of a literal list chosen by an integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def utc(ts: Column) -> Column:
    return ts.cast("timestamp")


def policies_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    published = F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))
    stamp = F.timestamp_seconds(F.lit(1704067200) + i * 60)
    return d.select(
        i.cast("string").alias("id"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("slug"),
        F.element_at(lines, -1).alias("title_zh"),
        F.element_at(lines, 1).alias("title_de"),
        F.col("source").alias("publisher"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), i.cast("string")).alias("official_url"),
        F.when(i % 40 != 0, published).alias("published_at"),
        F.when(i % 4 != 0, F.date_add(published, (i % 60).cast("int"))).alias("effective_at"),
        pick(LEVELS, i).alias("region_level"),
        pick(REGIONS, i).alias("region_name"),
        F.concat(F.lit("cat"), (i % 10).cast("string")).alias("category"),
        F.array("lang", "source").alias("target_groups"),
        F.col("text").alias("summary_zh"),
        F.array(pick(PHRASES, i)).alias("key_changes"),
        F.concat(F.lit("note "), i.cast("string")).alias("user_notes"),
        F.col("source").alias("impact_zh"),
        F.col("text").alias("content_zh"),
        F.when(i % 3 != 0, F.col("lang")).alias("content_de_summary"),
        pick(RISKS, i).alias("risk_level"),
        pick(STATUSES, i).alias("status"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.col("n_chars").cast("int").alias("view_count"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def policy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    empty = F.array().cast("array<string>")
    stamp = F.timestamp_seconds(F.lit(1704067200) + i * 60)
    return d.select(
        i.cast("string").alias("id"),
        F.concat(F.lit("key_"), i.cast("string")).alias("service_key"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("slug"),
        F.element_at(lines, -1).alias("title_zh"),
        F.element_at(lines, 1).alias("title_de"),
        F.when(i % 13 != 0, F.col("text")).alias("summary_zh"),
        F.when(i % 3 == 1, empty).when(i % 3 == 2, F.array("lang")).alias("requirements_zh"),
        F.when(i % 2 == 0, F.lit("10 Euro")).otherwise("").alias("fees_zh"),
        F.when(i % 5 != 0, F.lit("2 Wochen")).alias("duration_zh"),
        F.when(i % 4 == 0, F.array("lang", "source")).otherwise(empty).alias("steps_zh"),
        pick(LEVELS, i).alias("region_level"),
        F.col("source").alias("region_name"),
        F.concat(F.lit("cat"), (i % 10).cast("string")).alias("category"),
        F.when(i % 17 != 0, F.array("lang", "source")).alias("tags"),
        F.col("source").alias("publisher"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), i.cast("string")).alias("source_url"),
        F.col("source").alias("source_name"),
        (i % 7 != 0).alias("translated"),
        F.lit(None).cast("timestamp").alias("translated_at"),
        F.md5("text").alias("content_hash"),
        F.when(i % 50 != 0, F.timestamp_seconds(F.lit(1704067200) + (i % 1000) * 3600)).alias("last_fetched_at"),
        F.col("n_chars").cast("int").alias("view_count"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their customers; the customer side is joined by key, the dimensions are tiny."""
    geo = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    c = table(spark, sf_dir, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    i = F.col("o_orderkey")
    phrase = pick(JOB_PHRASES, i)
    empty = F.array().cast("array<string>")
    date = F.col("o_orderdate").cast("date")
    stamp = utc(F.col("o_orderdate"))
    return rows.select(
        i.cast("string").alias("refnr"),
        F.concat_ws(" ", phrase, "o_orderpriority").alias("title_de"),
        F.when(i % 5 == 1, "").when(i % 5 > 1, F.concat(F.lit("Stelle "), i.cast("string"))).alias("title_zh"),
        F.lit(None).cast("string").alias("brief_zh"),
        F.col("c_name").alias("employer"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state_code"),
        F.when(i % 3 == 0, F.array(F.lit("全职"))).when(i % 3 == 1, F.array(F.lit("兼职"), F.lit("远程")))
        .otherwise(empty).alias("work_type"),
        F.lit(False).alias("is_limited"),
        F.lit(None).cast("date").alias("entry_date"),
        F.when(i % 11 == 1, empty).when(i % 11 > 1, F.array("o_orderpriority", "c_mktsegment")).alias("tags"),
        F.when(i % 6 == 1, "x" * 20).when(i % 6 == 2, "x" * 21)
        .when(i % 6 > 2, F.concat_ws(" ", phrase, F.lit("bei"), "c_name", F.lit("im Bereich"), "c_mktsegment"))
        .alias("description_de"),
        F.when(i % 4 == 1, "").when(i % 4 == 2, "kurz").when(i % 4 == 3, "eine lange Beschreibung").alias("description_zh"),
        F.concat(F.lit("https://jobs.example/"), i.cast("string")).alias("source_url"),
        F.when(i % 97 != 0, date).alias("published_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        (i % 3 != 0).alias("translated"),
        F.lit(None).cast("timestamp").alias("translated_at"),
        stamp.alias("synced_at"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def _by_event(mapping: dict[str, str]) -> Column:
    result = None
    for name, value in mapping.items():
        hit = F.col("event_type") == name
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


QUEUE_STATUS = {"view": "pending", "click": "processing", "purchase": "done", "error": "failed", "signup": "skipped"}
REVIEW_STATUS = {
    "view": "ok", "click": "needs_update", "purchase": "source_changed", "error": "uncertain", "signup": "odd",
}
RUN_STATUS = {"view": "running", "click": "paused", "purchase": "completed", "error": "failed", "signup": "paused"}
RUN_MODES = ["backfill", "recent", "resume"]


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.cast("string").alias("id"),
        F.when(i % 2 == 0, "policy").otherwise("job").alias("source_type"),
        F.col("user_id").cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("source_url"),
        (F.floor("value") % 3).cast("int").alias("priority"),
        (i % 4).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        _by_event(QUEUE_STATUS).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        utc(F.col("ts")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("policy_id"),
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("policy_slug"),
        _by_event(REVIEW_STATUS).alias("review_status"),
        (F.col("value") / 50).alias("confidence"),
        pick(["keep", "update", "unpublish", "manual_check", "other"], i).alias("suggested_action"),
        utc(F.col("ts")).alias("reviewed_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), i.cast("string")).alias("run_id"),
        pick(RUN_MODES, i).alias("mode"),
        _by_event(RUN_STATUS).alias("status"),
        (F.col("user_id") % 9).cast("int").alias("source_index"),
        F.floor("value").cast("int").alias("request_used"),
        utc(F.col("ts")).alias("updated_at"),
        (utc(F.col("ts")) + F.make_interval(hours=F.lit(5))).alias("next_resume_at"),
    )


def budget_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_idx"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).cast("bigint").alias("cost"),
    )


NEW_PARAGRAPH = "<article><p>Neue Fassung der Regelung mit mehr als fuenfzig Zeichen, Seite "


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later fetch of every page: some unchanged, some altered, some failed."""
    i = F.col("page_id")
    altered = F.replace("html", F.lit("<article>"), F.concat(F.lit(NEW_PARAGRAPH), i.cast("string"), F.lit("</p>")))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("page_"), i.cast("string")).alias("service_key"),
        "url",
        F.when(i % 11 == 0, 304).when(i % 11 == 1, 404).when(i % 11 == 2, 0).otherwise(200).alias("status"),
        F.concat(F.lit("new-"), i.cast("string")).alias("etag"),
        F.when(i % 11 == 3, "").when(i % 11 > 1, F.when(i % 3 == 0, altered).otherwise(F.col("html"))).alias("body"),
        F.when(i % 11 == 2, F.lit("timeout")).alias("error"),
    )


def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier tags and content of the pages; every fifth page lived at another address then."""
    i = F.col("page_id")
    moved = i % 5 == 0
    return table(spark, sf_dir, "pages").select(
        F.when(moved, F.concat("url", F.lit("#moved"))).otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("old-"), i.cast("string")).alias("etag"),
        F.concat(F.when(moved, "moved_").otherwise("page_"), i.cast("string")).alias("service_key"),
        "html",
    )


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job search responses: every line item is a response page with two hits, built from its own columns."""
    part, supp = F.col("l_partkey").cast("string"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    n = F.col("l_linenumber")
    even = n % 2 == 0

    def item(refnr: Column) -> Column:
        return F.struct(
            F.when(even, refnr).alias("refnr"),
            F.when(n != 3, F.concat(F.lit("Stelle "), refnr)).alias("titel"),
            F.lit("Beruf").alias("berufsbezeichnung"),
            F.concat(F.lit("Firma "), F.col("l_suppkey").cast("string")).alias("arbeitgeber"),
            F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T08:00:00")).alias("aktuelleVeroeffentlichungsdatum"),
            F.lit("Region").alias("region"),
            F.struct(
                F.when(n % 4 != 0, F.concat(F.lit("Ort "), "l_returnflag")).alias("ort"),
                F.lit("Stadt").alias("stadt"),
                F.when(n % 3 != 0, F.col("l_linestatus")).otherwise("").alias("region"),
            ).alias("arbeitsort"),
            F.when(even, F.array(F.lit("VZ"), F.lit("xx"))).alias("arbeitszeit"),
            F.struct(refnr.alias("refnr"), F.array(F.lit("tz"), F.lit("ho")).alias("arbeitszeit")).alias("arbeitsmarktdaten"),
        )

    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        flag.alias("keyword"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("kw_ord"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("page"),
        F.to_json(F.struct(F.array(item(part), item(supp)).alias("stellenangebote"))).alias("body"),
    )


def feed_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document: every line is an item with CDATA, entities and three date styles."""
    i = F.col("doc_id").cast("string")

    def item(line: Column, n: Column) -> Column:
        num = n.cast("string")
        date = (
            F.when(n % 3 == 0, "Wed, 22 Apr 2026 10:00:00 GMT").when(n % 3 == 1, "2026-04-21").otherwise("")
        )
        return F.concat(
            F.lit("<item><title>"), line, F.lit(" &amp;amp; Antrag</title><link>https://feed.example/"), i, F.lit("/"), num,
            F.lit("</link><description><![CDATA[<b>"), line, F.lit("</b> Gesetz]]></description><pubDate>"), date,
            F.lit("</pubDate></item>"),
        )

    items = F.array_join(F.transform(F.split("text", "\n"), item), "")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_id"),
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example/rss/"), i).alias("url"),
        F.when(F.col("doc_id") % 9 == 0, 500).otherwise(200).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.when(F.col("doc_id") % 8 == 0, F.lit("<html>nothing here</html>"))
        .when(F.col("doc_id") % 8 == 1, F.lit("<rss></rss>"))
        .otherwise(F.concat(F.lit("<rss>"), items, F.lit("</rss>"))).alias("body"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as model replies about their conversation, in every accepted shape and two broken ones."""
    key = F.col("conv_id").cast("string")
    body = F.to_json(
        F.struct(
            key.alias("refnr"),
            F.col("text").alias("description_zh"),
            F.array("role", F.lit("IT/技术")).alias("tags"),
            F.concat(F.lit("Titel "), F.col("turn").cast("string")).alias("title_zh"),
        )
    )
    shape = (F.col("conv_id") + F.col("turn")) % 7
    text = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("["), body, F.lit("]")))
        .when(shape == 2, F.concat(F.lit('{"results":['), body, F.lit("]}")))
        .when(shape == 3, F.concat(body, F.lit("\n"), body))
        .when(shape == 4, F.concat(F.lit("Hier: "), body, F.lit(" Ende")))
        .when(shape == 5, F.concat(F.lit("\x01 "), body))
        .otherwise(F.concat(F.lit("kein JSON: "), "role"))
    )
    return table(spark, sf_dir, "conversations").select(
        key.alias("refnr"), F.col("turn").alias("turn"), "role", shape.alias("shape"), text.alias("reply_text")
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs: one log per user, one line per event."""
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Upserted item "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Skipped item "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Model requests used: "), F.floor("value").cast("string")))
        .when(
            F.col("event_type") == "error",
            F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Flushed "), F.floor("value").cast("string"), F.lit(" drafts into t")))
            .otherwise("usage limit reached; stopped early."),
        )
        .otherwise("Running source")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line")
    )
