"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import report_queries  # noqa: F401  registers its queries
from .plans.queries import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
