"""The queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import views

#: The entities of the reports for SQL.
WITH = "WITH " + views.SQL

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def fair_sql(aged: str, window: int = 200) -> str:
    """The fair order of q (id, account_id, created_at) and s (account_id, served_at) as the relation `fair`: rows up to the moment `aged` first, then a row of each account a round."""
    return f"""c AS (SELECT *, created_at <= {aged} AS old FROM (SELECT * FROM q ORDER BY created_at, id LIMIT {window})),
t AS (SELECT *, CASE WHEN old THEN row_number() OVER (ORDER BY NOT old, created_at, id::VARCHAR) END AS turn FROM c),
u AS (SELECT *, max(turn) OVER (PARTITION BY account_id) AS last_turn, CASE WHEN old THEN 0 ELSE row_number() OVER (PARTITION BY account_id, old ORDER BY created_at, id::VARCHAR) END AS round, min(created_at) OVER (PARTITION BY account_id, old) AS head FROM t),
fair AS (SELECT row_number() OVER (ORDER BY round, turn NULLS FIRST, last_turn IS NOT NULL, coalesce(last_turn, 0), coalesce(served_at, TIMESTAMP '0001-01-01 00:00:00'), head, u.account_id::VARCHAR) - 1 AS place, u.id, u.account_id FROM u LEFT JOIN s ON s.account_id = u.account_id)"""
