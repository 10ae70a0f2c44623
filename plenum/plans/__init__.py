"""Queries over the domain relations."""

from plenum.plans import aggregating, extracting, graphs, joining, metrics, selection, written  # noqa: F401
from plenum.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
