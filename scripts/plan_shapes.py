"""Print a condensed physical plan (operator counts) of each registered query.

    python scripts/plan_shapes.py [sf_dir] [name ...]

Counts shuffles (Exchange), join strategies, window operators and scans so a
change that adds a shuffle or a nested-loop join is visible at a glance.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from newslens.plans.queries import QUERIES  # noqa: E402
from newslens.session import build_session  # noqa: E402

WATCH = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit", "Window", "HashAggregate",
         "ObjectHashAggregate", "SortAggregate", "Generate", "InMemoryRelation", "TakeOrderedAndProject",
         "ArrowEvalPython", "BatchEvalPython", "FileScan")


def shape(plan: str) -> dict[str, int]:
    c = Counter()
    for line in plan.splitlines():
        m = re.search(r"(?:[+:|\- ]*)(?:\*\(\d+\) )?([A-Za-z]+)", line)
        if m and m.group(1) in WATCH:
            c[m.group(1)] += 1
    return dict(sorted(c.items()))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or list(QUERIES)
    spark = build_session("plans", "local[8]", 8)
    for name in only:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"{name:28s} {shape(plan)}")
    spark.stop()


if __name__ == "__main__":
    main()
