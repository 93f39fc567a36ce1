"""Registered queries: each operator applied to the given tables, with its SQL twin."""

from cutline.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
