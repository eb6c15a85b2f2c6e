"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verspan.plans.bindings import MODEL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, model: bool = True, recursive: bool = False):
    """Register a query under its function's name; ``sql`` continues the model's common table expressions."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{MODEL.strip()}{sql}" if model else sql
        return f
    return add
