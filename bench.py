"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 2); the fastest run counts.
Rows are produced in full and thrown away by the noop sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "facts_explode", "tag_fallback", "quarterly_series", "margin_trend", "metrics_wide", "sanity_confidence",
    "asof_nearest_close", "historical_multiples", "multiple_bands", "implied_growth",
    "drop_triggers", "severity_topk", "html_to_text", "section_extract", "news_topn",
    "ensemble_median", "val_grid", "majority_vote", "digest_gate",
    "last_vote", "ticker_history", "ledger_upsert", "benchmark_drift", "calibration_rollup",
    "debate_session_batch", "mention_extract", "stream_last_vote",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = sys.argv[1:] or HEADLINE
    from talus.checks import registry
    from talus.session import local

    spark = local(**{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="talus-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in only:
        best = None
        for _ in range(runs + 1):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None or took < best else best
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "sum of the fastest warm run of each headline query", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": spark.sparkContext.defaultParallelism,
        "spark": spark.version, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
