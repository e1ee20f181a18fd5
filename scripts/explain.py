"""Print the physical plan of analyses: scans (pushed filters, read schema),
exchanges and joins.  usage: python scripts/explain.py [sf_dir] name [name ...] [--full]"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoplens.plans import REGISTRY  # noqa: E402
from shoplens.session import local_session  # noqa: E402
from shoplens.sources.store import load_store  # noqa: E402


def summary(plan: str) -> str:
    keep = []
    for line in plan.splitlines():
        if re.search(r"Exchange|Join|Scan parquet|PushedFilters|ReadSchema|Aggregate|Window|Subquery|Expand|Sort |AQEShuffleRead", line):
            keep.append(line.rstrip()[:220])
    return "\n".join(keep)


def main():
    args = [a for a in sys.argv[1:] if a != "--full"]
    full = "--full" in sys.argv
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    store = load_store(spark, sf)
    for name in args:
        df = REGISTRY[name](store)
        df.collect()  # run through the DataFrame's own execution: final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"=== {name}")
        print(plan if full else summary(plan))


if __name__ == "__main__":
    main()
