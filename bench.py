"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then timed; cached frames are dropped in between, so that every timing includes
its own scan. The result is written to the ``noop`` sink.
"""

import json
import os
import statistics
import time

from alertfold.plans.catalog import CATALOG
from alertfold.session import local_session

HEADLINE = [
    "S1_read_alert_json", "P14_clean_alerts", "I1_dedup_alerts", "T1_bounded_reorder", "T4_lateness_counts",
    "A1_meta_sessions", "A2_capped_sessions", "A3_compound_windows", "A4_fixed_windows", "A9_simple_sessions",
    "A10_rolling_lookback", "A11_global_bursts", "A12_stream_counts", "F5_baseline_deviation", "F7_enrich_all",
    "M1_robust_scale", "M3_isolation_forest_score", "M8_decision_matrix", "E2_sensitivity_sweep", "E6_fpr_sweep",
    "E13_model_scorecard", "X5_inject", "X7_robustness_sweep", "D6_iat_stats", "D7_agent_profile",
]
REPEATS = 2


def run(spark, name: str, sf_dir: str) -> float:
    spark.catalog.clearCache()
    start = time.perf_counter()
    CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(REPEATS)), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores, "shuffle_partitions": cores, "spark": spark.version,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
