"""Look through every query's plan for joins and windows that cannot spread.

usage: python tools/plans.py [pattern ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check import entry, session  # noqa: E402

SUSPECTS = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def main():
    spark = session()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and not any(re.search(p, name) for p in sys.argv[1:]):
            continue
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        found = {s: plan.count(s) for s in SUSPECTS if s in plan}
        if found:
            print(name, found, flush=True)
            for line in plan.splitlines():
                if any(s in line for s in SUSPECTS[:3]):
                    print("    ", re.sub(r"#\d+L?", "", line.strip())[:170])


if __name__ == "__main__":
    main()
