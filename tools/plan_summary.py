"""Summarise the physical plan of every registered query (after AQE has run) as a
Markdown table: exchanges by kind, join strategies, top-k, map-side limits, aggregates,
pushed filters and partition filters."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    return {
        "hash exch": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range exch": len(re.findall(r"Exchange rangepartitioning", plan)),
        "rr exch": len(re.findall(r"Exchange RoundRobinPartitioning", plan)),
        "bcast exch": len(re.findall(r"BroadcastExchange", plan)),
        "single exch": len(re.findall(r"Exchange SinglePartition", plan)),
        "BHJ": len(re.findall(r"BroadcastHashJoin", plan)),
        "SMJ": len(re.findall(r"SortMergeJoin", plan)),
        "SHJ": len(re.findall(r"ShuffledHashJoin", plan)),
        "top-k": len(re.findall(r"TakeOrderedAndProject", plan)),
        "WGL partial": len(re.findall(r"WindowGroupLimit .*Partial", plan)),
        "hash agg": len(re.findall(r"(?<!Object)HashAggregate\(", plan)),
        "object agg": len(re.findall(r"ObjectHashAggregate\(", plan)),
        "sort agg": len(re.findall(r"SortAggregate\(", plan)),
        "pushed": "yes" if re.search(r"PushedFilters: \[[^\]]+\]", plan) else "",
        "partition filters": "yes" if re.search(r"PartitionFilters: \[[^\]]+\]", plan) else "",
        "python": "YES" if re.search(r"EvalPython|PythonUDF|MapInArrow|MapInPandas", plan) else "",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from logsmith.session import get_session
    from logsmith import registry

    spark = get_session("plans")
    rows = []
    for name, q in registry.QUERIES.items():
        df = q(spark, sf)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # run this plan so AQE finalises it
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        rows.append((name, summarize(plan)))
    cols = list(rows[0][1])
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
