"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores).  Results go
to Spark's ``noop`` sink, so every column is computed and nothing is collected.
Each query runs twice; ``queries`` holds the faster run, ``first_run`` the first
one, which includes code generation and JIT warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratavec.plans.queries import QUERIES  # noqa: E402
from stratavec.session import local_session  # noqa: E402

HEADLINE = (
    "sample_uniform",
    "sample_log_uniform",
    "cap_rows",
    "token_strings",
    "gather_vectors",
    "rotate_half_split",
    "rotate_by_layer_type",
    "query_position_scale",
    "batch_encode",
    "attention_logits",
    "attention_softmax",
    "sliding_window_pairs",
    "write_capture",
    "bucket_counts",
    "ordinal_example_id",
    "sample_heads",
)
RUNS = 2


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("stratavec-bench", cores, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: [run(QUERIES[name], spark, folder) for _ in range(RUNS)] for name in HEADLINE}
    best = {name: min(t) for name, t in times.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": {name: t[0] for name, t in times.items()},
                "runs": RUNS,
                "cores": cores,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
