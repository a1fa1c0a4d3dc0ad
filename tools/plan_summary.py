"""Summarise the physical plan of every registered query as a Markdown table.

    python tools/plan_summary.py [--sf /root/testdata/sf0.01] > PLANS.md

Counts come from the final adaptive plan, after AQE has re-planned the query
at run time.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "shj": plan.count("ShuffledHashJoin"),
        "nested_loop": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "windows": len(re.findall(r"\bWindow\b", plan)),
        "hash_agg": plan.count("HashAggregate") - plan.count("ObjectHashAggregate"),
        "sort_agg": plan.count("SortAggregate"),
        "scans": plan.count("FileScan"),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*", help="queries; all if none is named")
    args = ap.parse_args()
    from evolve.queries import QUERIES
    from evolve.session import get_spark
    # no side is broadcast here: the plans of sides too large for it
    spark = get_spark(extra={"spark.sql.autoBroadcastJoinThreshold": "-1",
                             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    cols = ["exchanges", "broadcasts", "bhj", "smj", "shj", "nested_loop", "windows", "hash_agg", "sort_agg",
            "scans"]
    print(f"# Physical plans at {os.path.basename(args.sf)} (final adaptive plans)\n")
    print("Generated by `python tools/plan_summary.py`. `exchanges` counts shuffles; `broadcasts` counts "
          "broadcast exchanges (AQE turns a join into one only after measuring the side).\n")
    print("Broadcasts are switched off, so these are the plans of sides too large to broadcast: sort-merge joins on the\n"
          "same keys (skew-split by AQE). The scans and exchanges of the fixtures are included. No plan contains a\n"
          "nested-loop or cartesian join.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in args.names or QUERIES:
        df = QUERIES[name](spark, args.sf)
        df.collect()  # runs this DataFrame's own execution, so its adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarise(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
