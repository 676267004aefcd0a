"""Registered queries over the standard tables."""

from paperlake.plans import aggregate_queries, join_queries, record_queries, registry, scalar_queries, search_queries, source_queries, vector_queries  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
