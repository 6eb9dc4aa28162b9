"""The registered queries over the operators of the survey, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


from . import ledger_queries, rule_queries, score_queries, source_queries, text_queries, trace_queries  # noqa: E402, F401
