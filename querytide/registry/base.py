"""How a query and its check SQL are put side by side."""

from __future__ import annotations

from querytide.fixtures import Query, check_views, view

SPARK: dict[str, Query] = {}
CHECK: dict[str, str] = {}


def check_sql(views: str, ctes: str, final: str) -> str:
    """One SQL text: fixture views, then further CTEs, then the final SELECT."""
    items = check_views(*views.split())
    if ctes:
        items.append(ctes)
    return ("WITH " + ",\n".join(items) + "\n" if items else "") + final


def register(name: str, views: str = "", sql: str | None = None, ctes: str = ""):
    """Register a query; without ``sql`` only its rows are checked."""

    def add(query: Query) -> Query:
        SPARK[name] = query
        if sql is not None:
            CHECK[name] = check_sql(views, ctes, sql)
        return query

    return add


__all__ = ["CHECK", "SPARK", "check_sql", "register", "view"]
