"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from . import anchor_queries, council_queries, index_queries, record_queries, registry  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
