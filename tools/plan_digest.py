"""Physical-plan digest of registered queries (after AQE re-planning).

usage: python tools/plan_digest.py [--sf DIR] [name ...]  > PLANS.md
Per query: exchanges by kind, windows, window group limits, joins, scans
with pushed filters, Python evaluation nodes.  Each query is executed once
(noop sink) so the final adaptive plan is reported.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def digest(plan: str) -> dict:
    d = {
        "hash exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range exchanges": len(re.findall(r"Exchange rangepartitioning", plan)),
        "round-robin": len(re.findall(r"Exchange RoundRobinPartitioning", plan)),
        "single-partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "reused": len(re.findall(r"ReusedExchange", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "group limits": len(re.findall(r"WindowGroupLimit", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "bhj": len(re.findall(r"BroadcastHashJoin", plan)),
        "python": len(re.findall(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas)", plan)),
        "nested loop / cartesian": len(re.findall(r"(BroadcastNestedLoopJoin|CartesianProduct)", plan)),
    }
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    return {k: v for k, v in d.items() if v} | ({"pushed": pushed} if pushed else {})


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from tangoflow.plans import catalog
    from tangoflow.session import build_session

    spark = build_session(8, "plan-digest", 8)
    qs = catalog.queries()
    print("# Physical plans of the registered queries (final adaptive plans, sf0.01, 8 partitions)\n")
    print("Generated by `tools/plan_digest.py`. Counts per query; `pushed` = filters pushed into Parquet scans.\n")
    print("| query | plan digest |\n|---|---|")
    for n in a.names or sorted(qs):
        df = qs[n](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        d = digest(plan)
        txt = "; ".join(f"{k}: {v}" for k, v in d.items())
        print(f"| `{n}` | {txt} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
