"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (comma separated) restricts the run.
"""

from __future__ import annotations

import json
import os
import time

from bazarlens.plans.registry import QUERIES
from bazarlens.session import build_session

HEADLINE = [
    "top_k_volume", "top_k_revenue", "ticket_gap", "price_stats",
    "classify_complaints", "dissatisfaction_rate", "top_k_per_pain", "ngram_counts", "top_ngrams",
    "rfm", "frequency_split", "robust_scale", "segment_summary", "silhouette", "k_search",
    "city_stats", "weighted_centroid", "coverage_stats", "heat_grid",
    "scan_json_doc", "render_context",
    "popularity", "candidate_pool", "item_cooccurrence", "item_cf_rank", "content_similarity", "recommend_all",
    "feedback_join", "feedback_metrics", "stream_event_counts", "stream_feedback",
    "segment_customers", "item_cf_similarity", "exclude_purchased", "kmeans_fit", "stream_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bazarlens-bench", f"local[{cpus}]", max(8, int(cpus)), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up cost of the JVM and of the Python workers is not a query's.
    QUERIES["top_k_volume"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
