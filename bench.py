"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES a comma list.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_lineitem",
    "quality_report_lineitem",
    "categorical_top_values",
    "histogram_price",
    "pivot_flag_by_status",
    "pivot_product_of_levels",
    "correlation_pairs_lineitem",
    "categorical_associations_lineitem",
    "trend_periods_month_sum",
    "mannwhitney_price_by_flag",
    "correlation_test_spearman",
    "chi_squared_flag_status",
    "causal_effect_dose",
    "join_key_candidates_orders_lineitem",
    "roc_curve_scored",
    "classification_metrics_status",
    "regression_metrics_forecast",
    "training_stats_lineitem",
    "check_drift_price_shift",
    "lag_features_events",
    "target_encode_supplier",
    "explain_anomaly_lineitem",
    "anomaly_scan_lineitem",
    "bm25_search_benchmark",
    "cosine_topk_centroids",
    "hybrid_search_benchmark",
    "chunk_documents",
    "latency_by_user",
    "holt_forecast_daily",
    "sql_inner_join_chain",
    "smote_toxic_documents",
    "permutation_importance_parts",
    "shapley_sampling_parts",
    "forecast_with_model_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    from pyspark.sql import SparkSession

    import workload

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.2f}  {name}", file=sys.stderr)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1).rstrip(".")) if found else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
