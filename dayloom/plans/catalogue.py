"""All registered queries; importing the modules fills the registry."""

from dayloom.plans import (  # noqa: F401
    queries_rows,
    queries_panel,
    queries_stats,
    queries_graphs,
    queries_models,
)
from dayloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
