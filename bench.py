"""Time the headline queries on one folder of data and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridwatt.queries import queries  # noqa: E402
from gridwatt.session import build_session  # noqa: E402

HEADLINE = [
    "h3_assign_regime", "d1_daily_curve_mean", "d2_ensemble_stats", "d4_spread_climatology", "d7_weighted_mean", "d13_parameterised_daily",
    "a8_upsert", "c7_asof_run", "e5_effective_temperature", "j10_scenario_weekly", "j14_scenario_run", "k1_block_values", "k13_gas_snapshot",
    "k14_fit_load_curve", "l2_quantify_anomaly", "m3_outlook_paths", "n6_correlation_grid", "n9_loo_regression",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "gridwatt-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # code generation and the file cache warm up on one small query that is not reported
    queries()["b7_iso_week"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
