"""Query plans over the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

from . import facts, graphs, registry, signals, stores


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


__all__ = ["facts", "graphs", "oracle_sql", "queries", "signals", "stores"]
