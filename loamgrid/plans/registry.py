"""The registered queries and their SQL."""

from __future__ import annotations

from .adapters import VIEWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, views: bool = True):
    """Registers a query by its name, with SQL that comes after the shared views where it says so."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (VIEWS.replace("WITH cell", "WITH RECURSIVE cell", 1) if views else "") + sql
        return f

    return keep
