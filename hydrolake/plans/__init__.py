"""Registered queries over the given tables, and their SQL."""

from hydrolake.plans import bathing_queries, general_queries, index_queries, measurement_queries
from hydrolake.plans.registry import QUERIES, SQL

__all__ = ["bathing_queries", "general_queries", "index_queries", "measurement_queries", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
