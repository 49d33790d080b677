"""Where plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with SQL over the same tables where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Events as frames, for the SQL of queries over episodes.
FRAMES_SQL = """frames AS (
  SELECT event_id, ts, user_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)"""
