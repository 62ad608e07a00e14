"""Registered queries, and the SQL they are checked against."""

from parity import checks, marts, slices, sources  # noqa: F401  (each module registers its queries)
from parity.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
