"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(*columns: str, digits: int = 6) -> str:
    """SQL of columns or ``expression AS name`` items rounded alike in both engines (no negative zero)."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round({expression or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


#: Candles of the events table in DuckDB's SQL; what ``sources.tables.candles`` reads.
CANDLES = """
bars AS (
  SELECT user_id AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trade_count,
    avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS liq
  FROM events GROUP BY user_id, date_trunc('hour', ts)),
candles AS (
  SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, open, high, low, close, volume, trade_count,
    (k - 50) / 2500 AS funding, 100 + 10 * k AS oi, liq FROM bars)"""


def over_candles(select: str, *more: str) -> str:
    return f"WITH {', '.join([CANDLES, *more])} {select}"
