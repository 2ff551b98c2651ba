"""The library's queries and the SQL that checks them."""

from __future__ import annotations

from .plans import queries as q


def queries() -> dict:
    return dict(q.FOUND)


def oracle_sql() -> dict:
    return dict(q.SQL)
