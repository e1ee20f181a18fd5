"""shoplens: web and commerce analytics as Spark DataFrame operators.

Every analysis is a function from DataFrames (sessions, pageviews, orders,
order items, refunds) plus parameters to a DataFrame.  Nothing is collected
to the driver; Catalyst plans each analysis end to end.
"""

from shoplens.sources.store import Store, load_store

__all__ = ["Store", "load_store"]
