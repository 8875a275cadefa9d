"""Headline benchmark: one JSON line with seconds per query (warm, median of three runs)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from amtskompass.plans import QUERIES  # noqa: E402
from amtskompass.session import local_session  # noqa: E402

HEADLINE = [
    "F1_list_policies_v1", "F2_list_policies_v2_page", "F3_list_jobs_page", "F4_text_search", "C17_normalize_policies",
    "A1_category_stats_v1", "A5_job_status", "J9_related", "J1_upsert", "J4_diff_pages", "J5_delist_missing", "J6_reconcile",
    "Q10_sync_jobs", "Q8_activation_length", "Q6_make_batches", "W4_budget_admission", "W3_latest_review", "U1_merge_job_hits",
    "H1_readable_text", "H2_basic_page", "H3_extract_guides", "H8_parse_feed", "C9_job_tags", "O5_suggestions", "R2_audit_reviews",
]


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    result: dict[str, float] = {}
    for name in wanted:
        timed(spark, name, sf_dir)  # warm-up
        result[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
        print(name, result[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(result.values()), 3), "unit": "sec", "queries": result,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
