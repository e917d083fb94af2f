"""Registry of queries: key -> Spark callable and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under key."""

    def register(f):
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def using(views: dict[str, str], sql: str) -> str:
    """sql after WITH clauses for the named views; a body may bring its own WITH."""
    head = ",\n".join(f"{name} AS ({body})" for name, body in views.items())
    body = sql.strip()
    return f"WITH RECURSIVE {head}, {body[5:].strip()}" if body[:5].upper() == "WITH " else f"WITH RECURSIVE {head}\n{body}"
