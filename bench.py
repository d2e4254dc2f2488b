"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "splits_written",  # first: later queries read a split table that is written once a session
    "deep_aggregates", "windowed_features", "two_level_features", "observed_windows", "screened_history",
    "time_split", "validation_part", "random_split", "missing_rate_shift", "maturity_check",
    "history_by_entity", "history_by_entity_cut", "history_global",
    "auc_by_split", "auc_by_split_cut", "all_metrics", "top_decile", "score_psi", "auc_standard_error", "paired_delong",
    "information_value", "single_feature_auc", "feature_psi", "target_rate_by_bin", "redundant_pairs", "screening_funnel",
    "table_profile", "column_statistics", "sentinel_candidates", "duplicate_rows", "duplicate_keys", "category_variants",
    "verdicts", "no_progress", "event_segments", "round_rows", "wasted_rounds", "regression_compare",
    "woe_table", "paired_bootstrap",
]


def main() -> None:
    from siftmill.queries.catalog import QUERIES
    from siftmill.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    for t in ("orders", "lineitem", "events"):  # start the JVM and read the footers before timing
        spark.read.parquet(f"{sf}/{t}.parquet").limit(1).collect()
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
