"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Every query writes all of its rows to a no-op sink. Each runs once on the smallest data
beside BENCH_SF_DIR first, as a job that takes minutes is not about compiling its code.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from groundwell.session import local_session  # noqa: E402
from workload import retrieval  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

HEADLINE = (
    "chunk_text",
    "bm25_topk",
    "vector_topk",
    "hybrid_rrf_acl",
    "hydrate_titles",
    "retrieval_eval",
    "pii_scrub",
    "document_rules",
    "commit_merge",
    "history_truncation",
    "stage_percentiles",
    "llm_breakdown",
    "cache_summary",
    "usage_daily",
    "cache_lookup",
    "grounding_sweep",
    "verify_sweep",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    # Built once and loaded by all queries that search it.
    start = time.perf_counter()
    retrieval.index_of(spark, sf_dir)
    times["lexical_index_build"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
