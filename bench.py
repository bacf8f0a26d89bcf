"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. All queries run once to warm up;
then each runs three times and the median counts, from building the plan to the last row computed.
Rows per second are over the rows of the tables that the query reads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketspark.plans.queries import QUERIES  # noqa: E402
from ticketspark.session import build_session  # noqa: E402

HEADLINES = {
    "triage_queue": ["orders", "lineitem"],
    "triage_queue_user": ["orders", "lineitem"],
    "unscored_default": ["orders", "lineitem"],
    "latest_prediction": ["lineitem"],
    "status_counts_by_user": ["orders"],
    "resolve_apply": ["orders", "events"],
    "request_windows": ["events"],
    "request_decisions": ["events"],
    "feedback_checked": ["labels", "documents"],
    "clean_texts": ["documents"],
    "clean_counters": ["documents"],
    "word_counts": ["documents"],
    "score_batch": ["documents"],
    "score_batch_python": ["documents"],
    "scoring_job": ["documents"],
    "noise_labels": ["orders"],
    "split_rows": ["orders"],
    "metrics": ["orders", "lineitem"],
    "tfidf_terms": ["documents"],
    "prompt_batches": ["orders", "conversations"],
    "reply_merge": ["orders", "conversations"],
    "csv_ingest": ["documents"],
    "contract_report": ["orders", "lineitem", "labels", "events"],
    "stream_request_windows": ["events"],
    "stream_request_decisions": ["events"],
    "stream_pending_scoring": ["documents"],
    "request_decisions_hot": ["events"],
    "baseline_model": ["documents"],
    "dedup_texts": ["documents"],
    "dataset_roundtrip": ["orders"],
    "purge_user_preview": ["orders", "lineitem", "events", "customer"],
    "first_rows": ["orders"],
    "newest_maintained": ["lineitem"],
    "scored_index": ["orders", "lineitem"],
    "event_store_newest": ["events"],
}


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINES)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rate = {}, {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
    for name in names:
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(3)), 3)
        rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in HEADLINES.get(name, ()))
        rate[name] = round(rows / seconds[name])
        print(f"{name} {seconds[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_median_warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rows_per_sec": rate, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
