"""Time the headline queries: ``BENCH_SF_DIR`` (tables) and ``BENCH_CPUS`` (local cores); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "features_velocity", "features_causal", "features_full", "expanding", "trailing_count", "target_enc", "target_enc_lagged",
    "time_split_3", "sequences", "capped_edges", "edge_phase", "neighbor_mean", "pr_curve", "slice_metrics", "threshold_sweep",
    "impact_sweep", "compare_models", "eval_battery", "weight_search", "column_drift", "drift_report", "uid_features",
    "quantile_normal", "d_summary", "device", "describe_by", "entity_state_stream", "sliding_fraud_rate", "dedupe", "train_gbt",
]


def main() -> None:
    from txnlens.plans import all_queries
    from txnlens.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    runnable = all_queries()[0]
    # One run outside the clock loads classes and the Python workers.
    runnable["features_velocity"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        runnable[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {f"{n}_rows_per_sec": round(rows / took[n]) for n in ("features_causal", "entity_state_stream", "eval_battery") if n in took}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")), **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
