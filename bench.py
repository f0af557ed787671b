"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver) three times: the first run pays plan
compilation and is reported as ``cold``; ``queries`` and ``value`` (their
sum) are the best of the two steady-state runs.  ``--all`` runs every
registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "build_kb", "html_to_text", "crawl_sitemaps", "resolve_fetch_attempts", "path_collisions",
    "topk_cosine", "nearest_l2", "retrieve_p", "answer_questions", "upsert_replace", "mean_pool",
    "truncation_loss", "score_requests", "request_metrics_daily", "embed_documents", "retrieve_by_text",
    "stream_request_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from kbspark.queries import QUERIES
    from kbspark.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    names = list(QUERIES) if "--all" in sys.argv else [q for q in HEADLINE if q in QUERIES]
    # Warm the JVM and the Python workers once (not timed), as on a long-running cluster.
    QUERIES["scan_pages"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, numPartitions=int(cpus)).mapInPandas(lambda it: it, "id long") \
        .write.format("noop").mode("overwrite").save()
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], warm[name] = runs[0], min(runs[1:])
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "sf": sf, "cpus": int(cpus),
                      "cold_total": round(sum(cold.values()), 3), "cold": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
