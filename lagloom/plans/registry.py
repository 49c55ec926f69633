"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations


def queries() -> dict:
    from lagloom.plans import byte_queries, rule_queries, run_queries  # noqa: F401  add their own
    from lagloom.plans.queries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    from lagloom.plans import byte_queries, rule_queries, run_queries  # noqa: F401
    from lagloom.plans.queries import SQL

    return dict(SQL)
