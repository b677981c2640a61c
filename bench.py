"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores; BENCH_ALL=1 times every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from groundshift.plans.queries import QUERIES
from groundshift.session import local_session

HEADLINE = [
    "a1_counts_by_type", "d1_priority", "d2_dedupe", "d3_reading_order", "j6_iou_pairs", "g4_explode_tiles",
    "g8_map_to_global", "g13_lit_points", "n3_parse_responses", "n6_response_boxes", "s8_build_requests",
    "s9_report_rows", "f4_visible_flag", "a6_summary_pick", "a8_progress", "x10_rescale_u8", "g7_crop",
    "j7_knn_hamming", "r1_match_descriptors", "r2_fit_homography", "r5_fallback_resize", "v1_detect",
    "e1_run_changes", "e3_run_images", "g7_crop_scaled", "r4_warp_perspective",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    # One small query starts the JVM code paths and the Python workers before anything is timed.
    QUERIES["v1_detect"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
