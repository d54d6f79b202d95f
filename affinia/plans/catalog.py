"""All queries of the engine, by name, and the SQL of those that SQL can express."""

from affinia.plans import ballot_queries, file_queries, other_queries, panel_queries  # noqa: F401  they register themselves
from affinia.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
