"""Import every query module so that the registry is complete."""

from tissuegrid.plans import geometry_queries, matrix_queries, metric_queries, model_queries, neighbor_queries  # noqa: F401
from tissuegrid.plans.registry import ORACLES, QUERIES  # noqa: F401
