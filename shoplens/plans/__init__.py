"""Named analyses (``REGISTRY``) with their parameters and SQL oracles."""

import importlib

from shoplens.plans.catalog import REGISTRY, Analysis

for _m in ("traffic_channel", "website", "seasonality_users", "products"):
    try:
        importlib.import_module(f"shoplens.plans.{_m}")
    except ModuleNotFoundError as e:  # group not written yet
        if e.name != f"shoplens.plans.{_m}":
            raise

__all__ = ["REGISTRY", "Analysis"]
