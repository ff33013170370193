"""A module's queries and their SQL."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    """(queries, SQL, decorator): ``@query(sql)`` adds a function under its name, and its SQL where there is one."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
