"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion with the ``noop`` sink (full
computation, nothing collected); the reported time is the best of
``BENCH_RUNS`` warm runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d1_dataset_summary_large",
    "d4_duplicate_rows_large",
    "d10_hourly_pattern_large",
    "d14_weather_stats_large",
    "d15_location_stats_large",
    "c1_anomaly_scores",
    "d46_anomaly_counts",
    "d46_anomaly_counts_large",
    "d29_box_stats_large",
    "d6_iqr_outliers",
    "d29_box_stats",
    "d20_day_hour_matrix",
    "e1_lag_rolling_features",
    "e4_sudden_slowdowns",
    "e7_peak_hours",
    "f1_sorted_by_time",
    "b4_label_encoding",
    "d36_sensor_fusion",
    "d37_environmental_impact",
    "d31_density_grid",
    "d30_detections_per_frame",
    "c5_track_matches",
    "e10_track_paths",
    "d34_congestion_hotspots",
    "b15_recommendations",
    "g12_isolation_forest_scores",
    "d42_model_comparison",
    "d43_model_evaluation",
    "d44_proposed_vs_existing",
    "h1_model_result_union",
    "h3_latest_results",
    "b29_proposed_rows",
    "b25_payload_roundtrip",
    "g3_random_forest_predictions",
    "g10_forest_uncertainty",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from corridor.plans import queries
    from corridor.session import build_session

    spark = build_session(f"local[{cpus}]", app="corridor-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = queries()
    missing = [n for n in HEADLINE if n not in qs]
    if missing:
        raise SystemExit(f"unknown headline queries: {missing}")
    names = HEADLINE
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": int(cpus), "runs": runs}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
