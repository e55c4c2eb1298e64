"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loadweave.catalog import QUERIES  # noqa: E402
from loadweave.session import build_session  # noqa: E402

HEADLINE = [
    "load_features", "hourly_gap_fill", "gap_report", "load_lags", "calendar_central", "core_features",
    "daily_core_features", "base_features", "align_join", "alignment_report", "dq_results", "describe_core",
    "fold_thresholds", "trend_oof", "model_comparison", "residual_corr", "error_gram", "feature_target_profile",
    "contract_validation", "score_batch", "idempotent_log", "knn_residual", "ml_linear_cv", "stream_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
