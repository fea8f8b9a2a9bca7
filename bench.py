"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and once timed; all rows are computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.queries import QUERIES  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

HEADLINE = [
    "src_union", "clean_rows", "contract_report", "rule_unique_lineitem", "run_metrics", "schema_evolve",
    "dedup_last", "dedup_last_lineitem", "transform_chain_rows", "transform_chain_range", "transform_chain_lineitem",
    "rolling_rows_frame", "rolling_range_frame", "rolling_range_dense", "feature_velocity", "feature_amounts", "feature_behavioral", "feature_risk",
    "feature_network", "feature_join", "snapshot_read", "backfill_transform", "load_check", "stream_ingest",
    "rolling_range_hot", "rolling_range_chunked", "feature_asof_join", "feature_asof_join_hot", "contract_profile", "contract_drift",
    "schema_variant", "network_risk_hops", "snapshot_changes", "backfill_after_changes", "stream_sessions", "job_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
