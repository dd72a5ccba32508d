"""All registered queries."""

from checks import coverage_queries, io_queries, layout_queries, manifest_queries, status_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
