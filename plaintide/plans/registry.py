"""Query registry: a key, the Spark callable and, where SQL can express it, the DuckDB twin."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from plaintide.plans.fixture import OPINION_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, needs_opinion: bool = True):
    """Registers a callable; ``sql`` may begin with its own WITH list and may use ``opinion``."""
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_opinion(sql) if needs_opinion else sql.strip()
        return fn
    return register


def with_opinion(sql: str) -> str:
    body = sql.strip()
    head = f"WITH opinion AS ({OPINION_SQL.strip()})"
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
