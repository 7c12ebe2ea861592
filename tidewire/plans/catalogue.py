"""Every registered query of the engine with its SQL counterpart."""

from __future__ import annotations

from . import q_articles, q_catalog, q_feeds, q_hazards, q_ops, q_providers, q_search

MODULES: tuple = (q_search, q_articles, q_hazards, q_ops, q_catalog, q_providers, q_feeds)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
