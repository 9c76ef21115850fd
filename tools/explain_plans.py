"""Print the shuffle/join/window skeleton of registered queries' physical plans.

Usage: python tools/explain_plans.py [sf_dir] name [name ...]
Shows Exchange, join and Window operators and the parquet scans (with their
pushed filters and read schema), i.e. what to look at when judging whether a
plan would hold at scale.  Planning only; nothing is executed.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEYS = ("Exchange", "Join", "Window [", "HashAggregate", "FileScan", "TakeOrderedAndProject", "InMemoryTableScan")


def main() -> None:
    from patchcraft.plans import catalog
    from patchcraft.session import get_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    spark = get_session(master="local[2]")
    for name in args or sorted(catalog.QUERIES):
        df = catalog.QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {name}")
        for line in plan.split("\n"):
            if any(k in line for k in KEYS):
                print("   ", line.rstrip()[:220])
    spark.stop()


if __name__ == "__main__":
    main()
