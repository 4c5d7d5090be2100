"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Each query is run once
to warm up and then timed once, every row produced and none kept.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from millrace.queries import QUERIES
from millrace.session import local_session

HEADLINE = (
    "word_count", "log_rollup", "pagerank", "transitive_closure", "kmeans_lloyd", "kmeans_wssse", "logreg_gd",
    "group_key_count", "indicator_ratio", "flat_map_words", "join_inner", "distinct_pairs", "reduce_by_key",
    "group_values", "vector_mean", "count_by_value", "top_n", "take_sample", "text_roundtrip",
    "asof_definition", "version_runs", "lineage_edges", "fanout_candidates", "reachable_sinks", "node_summary",
    "loop_invariant_inputs", "multi_use_datasets", "last_advice_per_line", "patch_lines", "patch_jobs",
)


def produce(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cores, shuffle_partitions=cores)
        spark.sparkContext.setLogLevel("ERROR")
        for name in names:
            produce(spark, name, sf_dir)
            seconds[name] = round(produce(spark, name, sf_dir), 3)
            print(name, seconds[name], flush=True)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
