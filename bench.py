"""Time the headline queries over whole tables; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Results
go to the no-op sink, so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corelode.operators.models import train_workflow
from corelode.plans import catalog
from corelode.session import build_session, forget
from corelode.sources.fixture import relation

HEADLINE = [
    "elements_summary", "data_summary", "quality_metrics", "quality_check", "lab_summary", "training_rows", "spatial_context", "heatmap_points",
    "element_pivot", "group_stats_join", "depth_cumulative", "depth_moving3", "interval_overlaps", "rolling10", "tonnage_curve", "avg_ranks",
    "geological_statistics", "anomalies", "element_correlations", "knn_join", "grid_nearest", "idw", "morans_i", "grade_continuity",
    "validation_report", "profile", "cap_outliers", "correlation_matrix", "drift_ks", "features_training", "features_neighbors", "features_all",
    "regression_metrics", "ks_2samp", "mann_whitney", "autocorrelation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    relation(spark, folder, "lineitem").agg({"*": "count"}).collect()  # start the executors
    seconds: dict[str, float] = {}
    for key in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        catalog.spark_query(key)(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        started = time.perf_counter()
        train_workflow(relation(spark, folder, "hole_samples"), "CU")  # the default: 100 trees of depth 6
        seconds["train_cu_100_trees"] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    forget(spark)
    spark.stop()


if __name__ == "__main__":
    main()
