"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated, optional).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from latticework import build_session  # noqa: E402
from latticework.registry import QUERIES, load_all  # noqa: E402

HEADLINE = ["neighbor_pairs", "pair_histogram", "nn_stats", "partial_rdf", "pair_features", "environment_sets",
            "unit_gate", "aug_split", "group_split", "cooccurrence", "profile_hist", "run_lengths", "hist_percentiles",
            "fuse_conf", "hits_at_k", "fit_temperature", "beam_rerank", "ingest_extxyz"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    load_all()
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8,
                          **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
