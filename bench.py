"""Benchmark: every registered analysis on one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3), BENCH_SHUFFLE_PARTITIONS (default: BENCH_CPUS).  The store (sessionized web tables, commerce
tables) is built once into a fresh folder under the checkpoint dir and timed
separately; each analysis then runs once to warm up and BENCH_REPEATS times,
executed in full through the ``noop`` sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoplens.plans import REGISTRY  # noqa: E402
from shoplens.session import checkpoint_root, local_session  # noqa: E402
from shoplens.sources.store import materialize  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", 0)) or (int(cpus) if cpus.isdigit() else 8)
    spark = local_session(cpus, app="shoplens-bench", shuffle_partitions=parts)
    root = f"{checkpoint_root(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:8]}"

    t0 = time.perf_counter()
    store = materialize(spark, sf_dir, root=root)
    build = time.perf_counter() - t0

    times = {}
    for name, analysis in REGISTRY.items():
        _run(analysis(store))  # warm-up: plan caches, JIT
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            _run(analysis(store))
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 4)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "wall seconds: store build plus the sum of the analyses' medians",
        "value": round(build + sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "store_build_sec": round(build, 3),
        "analyses_sec": round(sum(times.values()), 3),
        "cpus": cpus,
        "repeats": repeats,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
