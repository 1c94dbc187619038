"""All tabular and text queries by name, with their SQL counterparts."""

from __future__ import annotations

from . import base


def _load() -> None:
    from . import feature_queries, near_duplicate_queries, pair_queries, product_queries, relational_queries, tabular_queries, text_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
