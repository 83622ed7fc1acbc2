"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from longspan.plans import registry  # noqa: E402
from longspan.session import local_session  # noqa: E402

HEADLINES = (
    "measurement_stats_a2_a3_a4_p3",
    "concept_counts_a1",
    "medications_daily_j2_p4",
    "select_data_j6_o1",
    "sample_space_a9",
    "sample_uniform_o4",
    "asof_latest_j10",
    "recency_features_t13_f8",
    "measurement_curve_smoothed_t2_w2",
    "condition_intensity_smoothed_t3_w2",
    "binary_signal_carried_w4",
    "curves_t7",
    "projection_points_t15",
    "curve_stats_t14",
    "stats_merged_a13_u3",
    "scaler_m3",
    "dense_matrix_m1",
    "covariance_a23",
    "sources_covariance_l3_l6",
    "auc_a24",
    "shortened_texts_f12",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers
    available = registry.queries()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
