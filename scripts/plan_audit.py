"""Audit the final (adaptive) physical plans of all analyses: count shuffle
exchanges, joins and scans, and flag operators that do not scale (sort
aggregation, Expand, nested-loop or cartesian joins).  Walks the JVM plan
tree: adaptive plans, query stages, reused exchanges and subqueries.

usage: python scripts/plan_audit.py [sf_dir]"""

import json
import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoplens.plans import REGISTRY  # noqa: E402
from shoplens.session import local_session  # noqa: E402
from shoplens.sources.store import load_store  # noqa: E402

FLAGS = ["SortAggregate", "Expand", "BroadcastNestedLoopJoin", "CartesianProduct"]


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def walk(node, seen):
    key = node.hashCode(), node.nodeName()
    name = node.nodeName()
    if name == "ReusedExchange":
        yield "ReusedExchange"
        return
    if key in seen:
        return
    seen.add(key)
    yield name
    if name == "AdaptiveSparkPlan":
        yield from walk(node.executedPlan(), seen)
        return
    if name.endswith("QueryStage"):
        yield from walk(node.plan(), seen)
        return
    for sub in _seq(node.subqueries()):
        yield from walk(sub, seen)
    for child in _seq(node.children()):
        yield from walk(child, seen)


def audit(df) -> dict:
    df.collect()  # run through the DataFrame's own execution: final adaptive plan
    c = Counter(walk(df._jdf.queryExecution().executedPlan(), set()))
    row = {"shuffles": c["Exchange"], "broadcasts": c["BroadcastExchange"],
           "reused": c["ReusedExchange"], "smj": c["SortMergeJoin"],
           "bhj": c["BroadcastHashJoin"],
           "scans": sum(v for k, v in c.items() if k.startswith("Scan parquet"))}
    row.update({f: c[f] for f in FLAGS if c[f]})
    return row


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    store = load_store(spark, sf)
    for name, a in REGISTRY.items():
        print(f"{name:32s} {json.dumps(audit(a(store)))}")


if __name__ == "__main__":
    main()
