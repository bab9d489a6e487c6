"""All queries."""

from verification import queries_files, queries_reports  # noqa: F401
from verification.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
