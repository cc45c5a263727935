"""Registered queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame, with its oracle SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import concept_queries, graph_queries, more_queries, resolve_queries, review_queries, segment_queries, view_queries  # noqa: E402, F401
