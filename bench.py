"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], print one JSON line.

Each query is executed completely with the ``noop`` sink (no collect to the driver); the time
includes planning and any materialised intermediate tables the query writes.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "fold_report",          # flagship: cohort -> split -> oversample -> NB fit -> score -> report
    "split_assign",
    "oversample",
    "nb_score",
    "token_attribution",
    "consensus_top",
    "example_report",
    "auroc",                # lineitem: exact sparse-histogram AUROC / AUPRC per fold
    "scored_fold_report",
    "rank_normalise",
    "roc_curve",
    "tokenise",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from textcohort.session import local_session
    from textcohort.plans.registry import QUERIES

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="textcohort-bench")
    # warm-up: JVM code paths and Python workers, not timed
    QUERIES["minmax_scale"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "headline_queries_total_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    print(json.dumps(out))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
