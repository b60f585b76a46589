"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ringmatch.catalog import QUERIES
from ringmatch.session import local_session

HEADLINE = (
    "a9_recall_table",
    "j5_aligned_candidates",
    "w3_coarse_topk",
    "w4_exact_rerank",
    "e2_recall",
    "e3_mine_hard_negatives",
    "e4_plan_epoch",
    "e4_plan_epoch_hard_audit",
    "e1_manifest_from_index",
    "a1_bijection_audit",
    "j2_missing_pairs",
    "j3_inventory_reconciliation",
    "j9_schedule_violations",
    "a3_manifest_fingerprint",
    "u1_encode_gallery",
    "u2_encode_views",
    "p6_train_crop",
    "w1_seeded_shuffle",
    "w10_best_so_far",
    "a16_step_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, app="ringmatch-bench", shuffle_partitions=int(cpus))
    # Start the Python workers and load the parquet and Arrow paths before the clock starts.
    QUERIES["u1_encode_gallery"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
