"""The registered queries of the raster engine."""

from geoloom.plans import cell_queries, join_queries, scalar_queries  # noqa: F401
from geoloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
