"""All queries of the library by name, with equal SQL."""

from __future__ import annotations

from . import entities, prices, service, titles

_MODULES = (prices, entities, service, titles)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
