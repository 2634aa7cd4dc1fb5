"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to its last row (a no-op sink), best of two after one warm-up
of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sideline.plans.queries import REGISTRY  # noqa: E402
from sideline.session import build_session  # noqa: E402

HEADLINE = (
    "stat_lines", "event_rollup", "score_audit", "ewma_features", "feature_scores", "live_projections", "walk_forward",
    "walk_forward_matchup", "backtest_summary", "holdout_metrics_grouped", "opponent_asof", "latest_status", "depth_context",
    "match_ladder", "match_fuzzy", "parse_rosters", "parse_matchups", "comparison_finalized", "head_to_head",
    "league_snapshot", "waiver_top30_position", "ridge_weights",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
