"""Write analysis results as parquet tables (the result sets a client would
receive), one folder per analysis."""

from __future__ import annotations

from collections.abc import Iterable

from shoplens.plans.catalog import REGISTRY
from shoplens.sources.store import Store


def write_reports(store: Store, out_dir: str, names: Iterable[str] | None = None,
                  mode: str = "overwrite") -> list[str]:
    """Run the named analyses (default: all registered) on ``store`` and
    write each under ``out_dir/<name>``; returns the names written."""
    done = []
    for name in names or REGISTRY:
        REGISTRY[name](store).write.mode(mode).parquet(f"{out_dir.rstrip('/')}/{name}")
        done.append(name)
    return done
