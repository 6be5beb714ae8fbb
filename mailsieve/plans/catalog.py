"""Registered queries and their DuckDB oracles; the query modules fill both."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


for _module in ("q_content", "q_dlp", "q_links", "q_pages", "q_history", "q_scoring", "q_mailbox", "q_feeds"):
    importlib.import_module(f"{__package__}.{_module}")
