"""Seconds per headline query; one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs over its whole tables; results go to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfcast.catalog import collect_entries
from shelfcast.session import local_session, run_tables

HEADLINE = [
    "r01_reorder_plan",
    "v16_v17_history",
    "v15_spikes",
    "p02_daily",
    "p09_p13_dense_panel",
    "p10_observed_scope",
    "f14_engineer",
    "a01_a13_detect",
    "q03_quality_by_series",
    "m07_m11_scores",
    "m17_forecast",
    "d01_d02_feature_drift",
    "d06_d07_health",
    "g01_versions",
    "i01_i17_decisions",
    "x05_x06_matches",
    "x07_requests",
    "x08_transfers",
    "v20_validate_gated",
    "w03_transfer_states",
    "f05_f06_sparse_history",
    "d02_sketch_drift",
    "q01_q03_levels",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    entries, seconds = collect_entries(), {}
    for name in names:
        start = time.time()
        with run_tables(spark):
            entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
