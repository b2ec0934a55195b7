"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from linewise.plans.queries import QUERIES
from linewise.session import local_session

HEADLINES = [
    "production_order", "normalized_codes", "code_patterns", "period_of_carrier_places", "missing_carrier_slots",
    "burst_runs", "parameter_statistics", "record_verdicts", "group_quality", "quality_trend", "defect_cooccurrence",
    "defect_transitions", "code_spatial_associations", "label_conflicts", "upstream_checks", "truth_match",
    "followup_match", "exact_process_join", "nearest_time_join", "parameter_metrics", "binned_defect_rates",
    "average_ranks", "worksheet_events", "image_product_index", "leader_clusters", "spatial_trajectories", "alert_replay",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or os.cpu_count() or 8
    spark = local_session("linewise-bench", cores=int(cores), memory="16g")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the executor before timing
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
