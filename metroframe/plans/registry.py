"""Queries kept beside the SQL that gives the same rows."""

from __future__ import annotations


def registry():
    """(queries, SQL, decorator): the decorator files a function under its name with its SQL."""
    queries, oracles = {}, {}

    def query(sql: str):
        def keep(f):
            queries[f.__name__], oracles[f.__name__] = f, sql
            return f

        return keep

    return queries, oracles, query
