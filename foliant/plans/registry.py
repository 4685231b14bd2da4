"""Queries over the test tables, and the SQL that they are held against."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with the SQL of its result if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from . import growth_queries, project_queries, record_queries, run_queries, storage_queries  # noqa: E402, F401  (they register themselves)
