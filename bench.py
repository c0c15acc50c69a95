"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf"}.
Each query is planned and fully executed into Spark's ``noop`` sink (no driver collect).
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_top10",
    "tfidf_top10",
    "bm25_eval",
    "collection_stats",
    "zipf",
    "bigrams",
    "heaps",
    "query_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rankframe.session import local_session
    from rankframe.suite import QUERIES

    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    names = [n for n in (sys.argv[1:] or HEADLINE + [q for q in QUERIES if q not in HEADLINE and q in os.environ.get("BENCH_EXTRA", "").split(",")]) if n in QUERIES]
    # warm-up: JVM, codegen caches and parquet footers (not timed)
    QUERIES["collection_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
