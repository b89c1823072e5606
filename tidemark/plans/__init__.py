"""Registered queries over the shared tables, with their SQL oracles."""

from __future__ import annotations

from tidemark.plans import aggregates, gates, governance, markets, memory, regimes, relational, research, sequential, series, storage  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

FLAGSHIP = "flagship_symbol_report"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
