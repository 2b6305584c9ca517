"""All registered queries and their SQL checks."""

from claimlens.plans import relations, rows, search, tables  # noqa: F401  (each registers its queries)
from claimlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
