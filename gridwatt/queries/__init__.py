"""Registered queries: a Spark plan and, where SQL can say it, the same question in SQL."""

from . import base  # noqa: F401
from .base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
