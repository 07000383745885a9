"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion through the ``noop`` sink (full execution, nothing collected).
Derived tables memoised by the bindings are dropped before every query, so each timing includes
building its own inputs from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "build_graph",
    "feature_frequency",
    "cooccurrence_pairs",
    "build_graph_dictionary",
    "encode_features",
    "label_features",
    "probe_top_features",
    "feature_shift",
    "pairwise_cosine",
    "standardize",
    "accumulate_tokens",
    "split_3way",
    "louvain_round",
    "compare_graphs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cograph.plans import bindings
    from cograph.plans.catalog import QUERIES
    from cograph.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(int(cpus) * 2, 8) if cpus.isdigit() else 16, app="cograph-bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # warm-up: JVM, parquet footers, Python workers
    QUERIES["token_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        bindings._memo.clear()
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
