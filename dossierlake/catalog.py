"""All queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from dossierlake.plans import base, cases, documents, events, extraction, files, layout, relational, resolution  # noqa: F401  registers the queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)
