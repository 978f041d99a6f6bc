"""Registered queries: every operator on the driver's tables, with its SQL check.

``REGISTRY`` maps a query name to its Spark function and, where plain SQL can
say the same, to the SQL text.
"""

from riskloom.queries.registry import REGISTRY, Query
from riskloom.queries import (  # noqa: F401  (registration by import)
    cohorts,
    metrics,
    modelling,
    operating_points,
    screening,
    splits_summary,
    storage,
)

__all__ = ["REGISTRY", "Query"]
