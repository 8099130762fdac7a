"""How queries and their SQL are registered."""

from __future__ import annotations

from tracklens.plans.adapters import with_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers f(spark, sf_dir); sql: the same over the driver's tables and the named views of the catalogue."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views.split()) if views else sql
        return f

    return register
