"""Summarise the physical plan of every registered query.

For each query: shuffles (hash / range / single-partition exchanges),
broadcasts, Python nodes (Arrow UDFs, grouped maps; row-at-a-time Python UDFs
would show as BatchEvalPython and must not appear), sort-based aggregates, and
whether parquet scans carry pushed filters.  Usage:

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "arrow_udf": len(re.findall(r"ArrowEvalPython", plan)),
        "grouped_map": len(re.findall(r"FlatMapGroupsInPandas", plan)),
        "map_in_pandas": len(re.findall(r"MapInPandas", plan)),
        "row_python_udf": len(re.findall(r"BatchEvalPython", plan)),
        "sort_aggregate": len(re.findall(r"SortAggregate", plan)) // 2,
        "scans": len(re.findall(r"FileScan parquet", plan)),
        "scans_with_pushed_filters": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
    }


def main() -> None:
    from ledgerfold.plans.queries import QUERIES
    from ledgerfold.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    keys = list(summarize("").keys())
    print("| query | " + " | ".join(keys) + " |")
    print("| --- | " + " | ".join("---" for _ in keys) + " |")
    for name, fn in QUERIES.items():
        try:
            plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} |")
            continue
        s = summarize(plan)
        print(f"| {name} | " + " | ".join(str(s[k]) for k in keys) + " |")


if __name__ == "__main__":
    main()
