"""All registered queries."""

from lodestone.plans import algorithm_queries, relational_queries, source_queries, text_queries  # noqa: F401  they register themselves
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
