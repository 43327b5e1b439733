"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(key: str, oracle: str | None = None, headline: bool = False):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        if headline:
            HEADLINE.append(key)
        return fn
    return deco


def r6(c) -> F.Column:
    """Round a double to 6 digits (both engines do the same) for value-hash compares."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
