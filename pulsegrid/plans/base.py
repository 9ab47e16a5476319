"""Registry of queries with their SQL, and the SQL views that mirror the telemetry adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Readings per host and sensor, as ``adapters.telemetry`` gives them.
T = """t AS (SELECT event_id, ts, 'rpc-' || CAST(user_id % 10 AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) AS hostname,
 CAST(user_id % 10 AS INTEGER) AS rack_id, event_type AS sensor, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"""
#: Task intervals, as ``adapters.jobs`` gives them.
J = """j AS (SELECT l_orderkey AS job_id, l_linenumber AS task, l_suppkey AS host_id, l_shipdate AS start_time,
 l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS end_time, CAST(l_partkey % 128 + 1 AS DOUBLE) AS cpus, l_extendedprice AS power FROM lineitem)"""
#: Incidents, as ``adapters.truth`` gives them.
G = """g AS (SELECT event_id AS gt_id, CASE WHEN event_id % 50 = 0 THEN '*' ELSE 'rpc-' || CAST(user_id % 10 AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) END AS hostname,
 ['thermal','power','hardware','software','network'][CAST(event_id % 5 + 1 AS INTEGER)] AS category, ts AS event_start, ts + INTERVAL 1 HOUR AS event_end
 FROM events WHERE event_type = 'error')"""
W = "PARTITION BY hostname ORDER BY ts, event_id"
BY, ORDER = ["hostname"], ["ts", "event_id"]
TRAIN_END, VAL_END = "2024-01-20 00:00:00", "2024-01-25 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that the order of additions does not show."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x, digits) + F.lit(0.0)
