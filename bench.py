"""Benchmark the headline jobs; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each job is fully materialised through the ``noop`` sink (no collect to the
driver); the time includes building the query.  Reported per query: wall seconds; plus input rows/s for the jobs
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "tokenise",
    "rename_verdicts",
    "token_frequency",
    "spawn_patches",
    "collect_patches",
    "clean_patches",
    "changed_lines",
    "split_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from patchcraft.plans import catalog
    from patchcraft.session import get_session

    spark = get_session(
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) * 2,
        extra={"spark.driver.memory": "16g"},
    )
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).count()
    # Warm-up: JVM, code generation and the parquet reader.
    catalog.QUERIES["balanced_filter"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        # Timed from building the query (some jobs count split sizes while
        # planning) to the end of the write; no cache carries over.
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    rows_per_sec = {
        f"{k}_docs_per_sec": round(docs / times[k], 1)
        for k in ("tokenise", "rename_verdicts", "token_frequency", "spawn_patches")
        if times.get(k)
    }
    print(json.dumps({
        "metric": "headline_jobs_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "documents": docs,
        "rates": rows_per_sec,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
